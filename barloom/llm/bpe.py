"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The most frequent words of the whole corpus are merged once and compiled into a minimal acyclic automaton:
words that end alike share their suffix states. Its edges carry the number of words that sort before them, so
the path of a word sums to its rank, and the rank gives its token ids in a table. The automaton is one file of
flat arrays: driver and workers exchange it as a Spark file and map it into memory, so that all workers of a
machine share its pages. Looking words up steps through all distinct words of a batch at once. Words that
the lexicon lacks are merged exactly, also all at once. Results never depend on which words the lexicon has.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import map_texts, stage

# The public pattern that splits texts into words before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon. This bounds the automaton (a few MB) whatever the corpus.
LEXICON_WORDS = 65_536
#: Words longer than this (bytes) are left to merging.
LONGEST = 64


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes take the code points from 256 in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Pair ranks and token bytes of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, to_byte = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = ids[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[by], by.astype(np.int64), made

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of ids of each.

        Every round merges, in each word, the pair of lowest rank wherever it stands (left to right, without
        overlaps); words without such a pair are done and leave.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.made)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            if len(symbols) > 1:
                key = symbols[:-1] * self.size + symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), none - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = least == none
            if over.any():
                done.append((word[over], symbols[over]))
                stay = ~over
                symbols, word, rank, least = symbols[stay], word[stay], rank[stay], least[stay]
                if not len(symbols):
                    break
            spots = np.flatnonzero(rank == least)
            # in a run such as a a a the pair stands at every place; every other one is merged
            fresh = np.r_[True, np.diff(spots) != 1]
            nth = np.arange(len(spots)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            spots = spots[nth % 2 == 0]
            symbols[spots] = self.made[rank[spots]]
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- the transducer


def compile_lexicon(words: list[bytes], vocab: Vocabulary) -> bytes:
    """The automaton of distinct words as one file: a JSON line with the arrays' places, then the arrays."""
    words = sorted({w for w in words if 0 < len(w) <= LONGEST})
    edges: list[dict[int, int]] = [{}]
    final, registry = [False], {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word, not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            shape = (final[child], tuple(edges[child].items()))
            edges[parent][byte] = registry.setdefault(shape, child)

    last = b""
    for w in words:
        common = len(os.path.commonprefix([w, last]))
        share(common)
        state = path[-1][2] if path else 0
        for byte in w[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte, len(edges) - 1))
            state = len(edges) - 1
        final[state] = True
        last = w
    share(0)
    # number the states in use, and count the words below each: children come after parents, so backwards
    number, stack = {0: 0}, [0]
    order = [0]
    while stack:
        for child in edges[stack.pop()].values():
            if child not in number:
                number[child] = len(number)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def words_below(root: int) -> None:
        todo = [root]
        while todo:
            s = todo[-1]
            missing = [c for c in edges[s].values() if c not in below]
            if missing:
                todo += missing
            else:
                below[s] = final[s] + sum(below[c] for c in edges[s].values())
                todo.pop()

    words_below(0)
    key, target, skip = [], [], []
    for s in order:
        before = int(final[s])
        for byte, child in sorted(edges[s].items()):
            key.append(number[s] * 256 + byte)
            target.append(number[child])
            skip.append(before)
            before += below[child]
    by = np.argsort(np.array(key, np.int64)) if key else np.empty(0, np.int64)
    flags = np.zeros(len(number), np.uint8)
    for s, i in number.items():
        flags[i] = final[s]
    ids, counts = vocab.merge(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
    arrays = {
        "key": np.array(key, np.int64)[by], "target": np.array(target, np.int32)[by], "skip": np.array(skip, np.int32)[by], "final": flags,
        "start": np.r_[0, np.cumsum(counts)].astype(np.int64), "ids": ids.astype(np.uint32),
    }
    head, body = {}, b""
    for name, a in arrays.items():
        body += b"\0" * (-len(body) % 8)
        head[name] = [len(body), str(a.dtype), len(a)]
        body += a.tobytes()
    line = json.dumps(head).encode()
    return line + b" " * (7 - len(line) % 8) + b"\n" + body


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        end = self._map.find(b"\n") + 1
        for name, (at, kind, n) in json.loads(self._map[:end]).items():
            setattr(self, name, np.frombuffer(self._map, kind, n, end + at))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, or -1. All words step through the automaton together."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words) or not len(self.key):
            return out
        data, start = np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum(lengths)[:-1]]
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state, number = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for i in range(LONGEST):
            if not len(live):
                break
            key = state * 256 + data[start[live] + i]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state, number = self.target[at].astype(np.int64), number[ok] + self.skip[at]
            ended = lengths[live] == i + 1
            full = ended & (self.final[state] == 1)
            out[live[full]] = number[full]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


@lru_cache(maxsize=2)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def encode_texts(texts: list[str | None], vocab: Vocabulary, lexicon: Lexicon | None, specials: bool = True) -> list[np.ndarray]:
    """Token ids (uint32) of each text. specials: whether special tokens' strings in a text become their ids."""
    split, numbers = _splitter(PATTERN).findall, {}
    found: list[int] = []
    spans: list[int] = []
    inside = [s for s in vocab.special if specials]
    for t in texts:
        t = t or ""
        before = len(found)
        marks = [s for s in inside if s in t]
        pieces = regex.split("(" + "|".join(map(regex.escape, sorted(marks, key=len, reverse=True))) + ")", t) if marks else [t]
        for i, piece in enumerate(pieces):
            if i % 2:
                found.append(-1 - vocab.special[piece])
            else:
                found += [numbers.setdefault(w, len(numbers)) for w in split(piece)]
        spans.append(len(found) - before)
    words = [w.encode() for w in numbers]
    at = lexicon.find(words) if lexicon else np.full(len(words), -1, np.int64)
    new = np.flatnonzero(at < 0)
    ids, counts = vocab.merge([words[i] for i in new]) if len(new) else (np.empty(0, np.int64), np.empty(0, np.int64))
    size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    size[new], start[new] = counts, np.r_[0, np.cumsum(counts)][:-1]
    table = ids
    if lexicon is not None and len(new) < len(words):
        old = np.flatnonzero(at >= 0)
        start[old] = lexicon.start[at[old]]
        size[old] = lexicon.start[at[old] + 1] - start[old]
        start[new] += len(lexicon.ids)
        table = np.r_[lexicon.ids, ids]
    code = np.array(found, np.int64)
    special = code < 0
    if special.any():
        # special tokens get entries of their own behind the table
        own, code[special] = np.unique(-1 - code[special], return_inverse=True)
        code[special] += len(words)
        start, size = np.r_[start, len(table) + np.arange(len(own))], np.r_[size, np.ones(len(own), np.int64)]
        table = np.r_[table, own]
    if not len(code):
        return [np.empty(0, np.uint32) for _ in texts]
    flat = table[_spread(start[code], size[code])].astype(np.uint32)
    each = np.cumsum(np.r_[0, size[code]])[np.cumsum(np.r_[0, spans])]
    return [flat[a:b] for a, b in zip(each[:-1], each[1:], strict=True)]


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents, counted whole; at most `most`, without those at the edge.

    A histogram of counts (a few hundred rows) tells which counts fit, so that only the words themselves reach
    the driver, however many tasks there are.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("word"))
    words = words.where(F.octet_length("word") <= LONGEST)  # the lexicon takes no longer ones, so they are neither counted nor collected
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = stage(counts.withColumn("bin", F.floor(8 * F.log2("n")).cast("int")), "words")
    left, least = most, None
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["bin"]
    return [] if least is None else sorted(r[0] for r in counts.where(F.col("bin") >= least).select("word").collect())


def ship_lexicon(spark: SparkSession, words: list[str], tokenizer: str) -> str:
    """Compiles a lexicon and gives it to all executors as a Spark file; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(path, "wb") as f:
        f.write(compile_lexicon([w.encode() for w in words], vocabulary(tokenizer)))
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, text: str = "text", lexicon: str | None = None, specials: bool = True) -> DataFrame:
    """The columns keep (default: doc_id) of each row, n_tokens and ids (binary, little-endian unsigned 32 bits).

    tokenizer: path of a byte-level BPE file, there on all machines. lexicon: the name that ship_lexicon gave;
    None: one is made from the frequent words of docs. Null and empty texts have no ids. Rows keep
    their number: ties and repeats are encoded each. Long texts and long words are encoded whole, whatever the lexicon holds. Columns of other names don't
    matter; an empty table gives no rows.
    """
    lexicon = lexicon or ship_lexicon(docs.sparkSession, frequent_words(docs, text), tokenizer)

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        ids = encode_texts(texts, vocabulary(tokenizer), _lexicon(lexicon), specials)
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}

    return map_texts(docs, keep or ["doc_id"], text, "n_tokens long, ids binary", run)


def decode(encoded: DataFrame, tokenizer: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns keep and decoded (string): the bytes of all tokens, special ones too, read as UTF-8 with
    malformed parts replaced. Null and empty ids decode to the empty text. Rows keep their number, long ones are decoded whole; other columns are not
    read, and an empty table gives no rows."""

    def run(rows: list[bytes | None]) -> dict[str, pa.Array]:
        of = vocabulary(tokenizer).bytes
        return {"decoded": pa.array([b"".join([of[i] for i in np.frombuffer(x or b"", "<u4").tolist()]).decode("utf-8", "replace") for x in rows], pa.string())}

    return map_texts(encoded, keep, ids, "decoded string", run)
