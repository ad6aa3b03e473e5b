"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text is encoded: its words and the three-byte pieces of its
words are counted in hashed buckets, each with a learned embedding, along with a few shares of its characters and words. The
sum of these embeddings, through a tanh, is the passage's vector h. Gated attention weighs the passages,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )

and a logistic unit scores the weighted sum. Only document labels are needed: which passages matter is learned, together with the
embeddings. The network is fitted in numpy on a bounded sample of whole labelled documents (at most TRAIN_DOCS with TRAIN_PASSAGES passages
in all); scoring runs in Arrow batches over all passages of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import map_texts, word_count

PASSAGE = 64
#: The training sample: documents, and the passages that they may have in all. Documents are taken whole or not at all.
TRAIN_DOCS, TRAIN_PASSAGES = 6_000, 60_000
EMBED, GATE, EPOCHS, BATCH, RATE, DECAY = 16, 8, 40, 256, 0.005, 1e-3

_SYMBOL, _PIPE, _BANG, _UPPER, _LOWER, _DIGIT, _STOP, _LINE, _HIGH, _QUOTE = range(10)
_CLASSES = np.zeros((10, 256), np.uint8)
for _row, _bytes in ((_SYMBOL, b"#*$%&<>@^~_={}[]\\"), (_PIPE, b"|"), (_BANG, b"!?"), (_DIGIT, b"0123456789"), (_STOP, b".,;:"), (_LINE, b"\n"), (_QUOTE, b"\"'()-/")):
    _CLASSES[_row, list(_bytes)] = 1
_CLASSES[_UPPER, 65:91], _CLASSES[_LOWER, 97:123], _CLASSES[_HIGH, 128:] = 1, 1, 1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: Odd multipliers by a byte's place in its word: a word's hash is the sum over its bytes.
_PLACES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Buckets of words and of three-byte pieces (the top BITS bits of a hash), and shares after them.
BITS, SHARES = 8, 14
BUCKETS = 1 << BITS
FEATURES = 2 * BUCKETS + SHARES


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of all texts, one after the other: uint8 counts by bucket (255 and more are 255), float32 shares; and the number of
    passages of each text. A text without words is one passage of zeros."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    inside = ~_BLANK[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    before = np.searchsorted(starts, begins)  # words before each text
    n_words = np.diff(np.r_[before, len(starts)])
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(per_text) - per_text
    total = int(per_text.sum())
    text_of = np.repeat(np.arange(len(raw)), per_text)
    nth = np.arange(total) - base[text_of]
    # a text's first passage begins with the text, others with their first word
    bounds = np.where(nth == 0, begins[text_of], 0)
    later = np.flatnonzero(nth)
    bounds[later] = starts[before[text_of[later]] + nth[later] * PASSAGE]
    in_passage = np.minimum(n_words[text_of] - nth * PASSAGE, PASSAGE)

    passage = np.repeat(np.arange(total), in_passage)  # of each word
    word = np.cumsum(_marks(len(data), starts)) - 1
    place = (np.arange(len(data)) - (starts[np.maximum(word, 0)] if len(starts) else 0)) & 63
    with np.errstate(over="ignore"):
        mixed = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _PLACES[place], np.uint64(0))
        hashed = np.add.reduceat(mixed, starts) if len(starts) else np.empty(0, np.uint64)
        bucket = ((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
        words = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS)
        at = np.flatnonzero(inside)
        near = np.where(inside, data, np.uint8(32)).astype(np.uint32)
        piece = near[at - 1] | near[at] << np.uint32(8) | near[at + 1] << np.uint32(16)
        bucket = ((piece * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        pieces = np.bincount(passage[word[at]] * BUCKETS + bucket, minlength=total * BUCKETS)
    counted = np.minimum(255, np.concatenate([words.reshape(total, BUCKETS), pieces.reshape(total, BUCKETS)], 1)).astype(np.uint8)

    counts = np.stack([np.add.reduceat(c[data], bounds, dtype=np.int64) for c in _CLASSES], 1).astype(np.float64)
    # capital letters of two bytes (C3 80 .. C3 9E) belong to the capitals too
    wide = np.zeros(len(data), np.uint8)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    counts[:, _UPPER] += np.add.reduceat(wide, bounds, dtype=np.int64)
    n = np.maximum(1, in_passage).astype(np.float64)
    chars = np.bincount(passage, ends - starts, total)
    same = np.r_[False, (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])] if len(starts) else np.empty(0, bool)
    order = np.lexsort((hashed, passage))
    h, p = hashed[order], passage[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])] if len(starts) else np.empty(0, bool)
    distinct = np.bincount(p[first], minlength=total)
    letters = np.maximum(1, counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH] / 2)
    per = lambda c: np.minimum(3, counts[:, c] / n)
    shares = np.stack(
        [
            per(_SYMBOL), per(_PIPE), per(_BANG), counts[:, _UPPER] / letters, counts[:, _DIGIT] / np.maximum(1, chars), per(_STOP), per(_LINE), counts[:, _HIGH] / np.maximum(1, chars), per(_QUOTE),
            np.minimum(4, chars / n / 5), distinct / n, np.bincount(passage, same, total) / n, np.log1p(in_passage) / 4, np.log1p(n_words[text_of]) / 10,
        ],
        1,
    ).astype(np.float32)
    shares[in_passage == 0] = 0
    return counted, shares, per_text


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int32)
    out[at] = 1
    return out


def inputs(counted: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """float32 inputs of the network: square roots of the buckets' counts, a word's worth each, then the shares."""
    return np.concatenate([np.sqrt(counted.astype(np.float32) / PASSAGE), shares], 1)


class Model:
    """Embeddings, gated attention and a logistic score; parameters in the dictionary p."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags, bag by bag; bags: where each bag begins."""
        p = self.p
        z = (x - p["mean"]) / p["scale"]
        h = np.tanh(z @ p["W"] + p["b"])  # W: an embedding for each bucket and share
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["w"]
        sizes = np.diff(np.r_[bags, len(x)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags), sizes))
        a = e / np.repeat(np.add.reduceat(e, bags), sizes)
        m = np.add.reduceat(h * a[:, None], bags)
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "m": m, "sizes": sizes, "y": 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(x, np.cumsum(sizes) - sizes)["y"] if len(sizes) else np.empty(0)


LEARNED = ["W", "b", "V", "U", "w", "c", "d"]


def gradients(model: Model, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags."""
    p, f = model.p, model.forward(x, starts)
    g_out = (f["y"] - labels) / len(labels)
    back = lambda v: np.repeat(v, f["sizes"], axis=0)
    g_m = back(g_out[:, None] * p["c"])
    g_a = (g_m * f["h"]).sum(1)
    g_e = f["a"] * (g_a - back(np.add.reduceat(f["a"] * g_a, starts)))
    g_t, g_s = g_e[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), g_e[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
    g_h = (g_m * f["a"][:, None] + g_t @ p["V"].T + g_s @ p["U"].T) * (1 - f["h"] ** 2)
    return {
        "W": f["z"].T @ g_h, "b": g_h.sum(0), "V": f["h"].T @ g_t, "U": f["h"].T @ g_s, "w": (f["t"] * f["s"]).T @ g_e,
        "c": f["m"].T @ g_out, "d": g_out.sum(),
    }


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the mean log loss in batches of BATCH bags. x: passages of all bags, bag by bag; sizes: passages of each. Without
    both labels the score is the constant share of good ones."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    labels, sizes = np.asarray(labels, np.float32), np.asarray(sizes, np.int64)
    share = (float(labels.sum()) + 1) / (len(labels) + 2)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    p = {
        "mean": x.mean(0) if len(x) else np.zeros(n, np.float32), "scale": (x.std(0) if len(x) else np.zeros(n, np.float32)) + np.float32(1e-2), "W": normal(n, EMBED), "b": np.zeros(EMBED, np.float32),
        "V": normal(EMBED, GATE), "U": normal(EMBED, GATE), "w": normal(GATE), "c": np.zeros(EMBED, np.float32), "d": np.float32(np.log(share / (1 - share))),
    }
    model = Model(p)
    if len(set(labels.tolist())) < 2:
        return model
    starts = np.cumsum(sizes) - sizes
    m1, m2 = ({k: np.zeros_like(p[k]) for k in LEARNED} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            step, of = step + 1, order[lo : lo + BATCH]
            begin = np.cumsum(sizes[of]) - sizes[of]
            rows = np.arange(sizes[of].sum()) - np.repeat(begin - starts[of], sizes[of])
            g = gradients(model, x[rows], begin, labels[of])
            for k in LEARNED:
                grad = g[k] + (DECAY * p[k] if k not in ("b", "d") else 0)
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * grad, 0.999 * m2[k] + 0.001 * grad**2
                p[k] = (p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS, passages: int = TRAIN_PASSAGES) -> Model:
    """Fits a model on labelled documents in the order of a hash of their ids: at most `most` documents that have `passages` passages in all.
    Each of them is taken whole, and one with more passages than that is no training document.

    labels: doc_id and label (1 or 0; nulls are left out, of repeated labels the highest counts). Rows of docs that repeat an id are one
    training document, the one with the greatest text; null ids are never labelled; null and empty texts are one passage of zeros. Other
    columns are not read. Empty tables give a model with one score for all.
    """
    known = labels.where("label is not null").groupBy(doc_id).agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64(doc_id), doc_id).limit(most)
    body = F.coalesce(F.col(text), F.lit(""))
    picked = docs.select(doc_id, body.alias("__text")).join(F.broadcast(known), doc_id).groupBy(doc_id, "label").agg(F.max("__text").alias("__text"))
    picked = picked.withColumn("__n", F.greatest(F.ceil(word_count(F.col("__text")) / PASSAGE), F.lit(1))).where(F.col("__n") <= passages)
    # at most `most` rows by now, so one window holds them
    so_far = F.sum("__n").over(Window.orderBy(F.xxhash64(doc_id), doc_id).rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("__sum", so_far).where(F.col("__sum") <= passages)

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        counted, shares, sizes = encode(texts)
        ends = np.cumsum(sizes)
        split = lambda a: pa.array([a[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)], pa.binary())
        return {"counted": split(counted), "shares": split(shares)}

    rows = map_texts(picked, [doc_id, "label"], "__text", "counted binary, shares binary", run).collect()
    rows.sort(key=lambda r: r[0])
    counted = np.frombuffer(b"".join(r["counted"] for r in rows), np.uint8).reshape(-1, 2 * BUCKETS)
    shares = np.frombuffer(b"".join(r["shares"] for r in rows), np.float32).reshape(-1, SHARES)
    sizes = [len(r["shares"]) // (4 * SHARES) for r in rows]
    return fit(inputs(counted, shares), np.array(sizes, np.int64), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns keep (default: doc_id) of every row, n_passages and score (0 to 1).

    Null and empty texts are one passage of zeros and get its score; long texts are scored over all their passages. Rows are independent:
    null ids, ties and repeated rows each get their score, equal texts equal ones. Columns that are not in keep are not read, whatever
    their names; an empty table gives no rows.
    """
    params = model.p

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        counted, shares, sizes = encode(texts)
        return {"n_passages": pa.array(sizes, pa.int64()), "score": pa.array(Model(params).score(inputs(counted, shares), sizes).astype(np.float64))}

    return map_texts(docs, keep or ["doc_id"], text, "n_passages long, score double", run)
