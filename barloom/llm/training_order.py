"""Training-order materialisation: token sequences at keyed, permuted places in fixed-stride shards.

Documents, in order of their ids and each closed by an end token, form one stream of tokens that is cut into sequences of
`length` tokens (the last one is filled up with end tokens). A keyed Feistel network over the sequence numbers, with cycle-walking
to stay below their count, is a permutation: it gives every sequence its slot in the training order without a sort, a random draw or
a table, and can be inverted. Slots are dealt to shards by range; each shard is one file in which slot s stands at
byte (s mod slots a shard) * stride, so that a reader can start or resume anywhere with one seek.

Texts are read and tokenised once: ids are written, compressed, with their counts, which give each document its place in the stream
(running sums within stretches of ids, and over the stretches). A second pass over the ids cuts them into pieces, and sends all pieces
that a task has for a shard as one compressed parcel to the partition of that range of shards. A shard's task fills one
buffer of the shard's size, at most MOST_SLOTS strides, checks that every token has come, and renames the finished file into place:
a lost executor's task runs again and writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import map_texts, stage, stage_path, stretch

LENGTH, ROUNDS = 1024, 8
#: Slots of a shard: about 1/256 of all, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 64, 32_768
#: Places of documents are broadcast up to so many (about 113 bytes each), and joined by shuffle beyond.
BROADCAST_DOCS = 1_000_000
STRETCH = 1_000
#: Tokens (as bytes) that a task cuts at once, and partitions of the final shuffle at most: beyond, one has several shards in turn.
CUT_BYTES, MOST_PARTITIONS = 64_000_000, 8_192
#: A piece of a document within a parcel.
PIECE = np.dtype([("slot", "<i4"), ("at", "<i4"), ("n", "<i4"), ("doc", "<i8"), ("null", "?")])


# --- the permutation


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Permutation:
    """A keyed permutation of 0 .. n - 1, on arrays of numbers."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.blake2b(key.to_bytes(16, "little", signed=True), digest_size=8 * min(8, ROUNDS)).digest()
        self.keys = np.frombuffer(digest, np.uint64)

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (_mix(left, k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & self.mask)
        return (left << self.half) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = self._network(np.asarray(numbers).astype(np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._network(x[out], back)
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


# --- tokens


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _layout(counts: DataFrame) -> DataFrame:
    """counts: __id, __body, n. Adds start: the tokens of all documents before. Repeated rows are one document."""
    counts = stage(counts.groupBy("__id", "__body").agg(F.max("n").alias("n")), "counts")
    counts = counts.withColumn("__at", stretch(counts.select("__id", "__body"), STRETCH))
    before = F.coalesce(F.sum("m").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy("__at").agg(F.sum("n").alias("m")).select("__at", before.alias("before"))
    inside = Window.partitionBy("__at").orderBy(F.col("__id").asc_nulls_first(), "__body").rowsBetween(Window.unboundedPreceding, -1)
    started = counts.join(sums, "__at").select("__id", "__body", "n", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))
    return stage(started, "starts")


def materialise(
    docs: DataFrame, ranks: str, pattern: str, folder: str | None = None, length: int = LENGTH, key: int = 20_24, doc_id: str = "doc_id", text: str = "text", end: int | None = None
) -> DataFrame:
    """Writes all shards and returns one row for each sequence: slot, shard, offset (bytes), sequence (its number in the stream),
    first_doc_id (the document of its first token), n_tokens (without filling), ids_sha256 (of its whole stride).

    ranks, pattern: a rank file, there on all machines, and the pattern that splits texts. end: the end token
    (default: the number of ranks). Ids take 2 bytes below 65,536 ids, else 4, little-endian. folder: a new folder that all machines
    reach. It gets index.json and one file a shard. doc_id holds whole numbers, or text of such; other text is an error. Null and empty
    texts are an end token alone; null ids come first, ordered by a hash of their texts, as are ties of an id; rows that repeat id and
    text are one document; long texts are cut like others; an empty table writes an index without shards and returns no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or stage_path(spark, "shards")
    enc = _encoder(ranks, pattern)
    end = enc.n_vocab if end is None else end
    kind = "<u2" if max(end, enc.max_token_value) < 1 << 16 else "<u4"
    body = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(body).alias("__body"), body.alias("__text"))

    def tokens(texts: list[str]) -> dict[str, pa.Array]:
        e = _encoder(ranks, pattern)
        ids = [np.array([*e.encode_ordinary(t), end], kind).tobytes() for t in texts]
        return {"n": pa.array([len(x) // np.dtype(kind).itemsize for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    coded = stage(map_texts(src, ["__id", "__body"], "__text", "n long, ids binary", tokens), "ids", level=6)
    starts = _layout(coded.select("__id", "__body", "n"))
    total, n_docs = starts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n = -(-total // length)
    slots = max(LEAST_SLOTS, min(MOST_SLOTS, -(-n // 256)))
    shards = -(-n // slots)
    stride = length * np.dtype(kind).itemsize
    _put(folder, "index.json", json.dumps({"sequences": n, "tokens": total, "length": length, "dtype": kind, "stride": stride, "slots_per_shard": slots, "key": key, "end": end}).encode())

    places = starts.select(F.col("__id").alias("p_id"), F.col("__body").alias("p_body"), "start")
    if n_docs <= BROADCAST_DOCS:
        places = F.broadcast(places)  # ids then stay where they are
    placed = coded.join(places, F.col("__id").eqNullSafe(F.col("p_id")) & (F.col("__body") == F.col("p_body"))).select("__id", "start", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(n, key)
        for whole in batches:
            ends = np.cumsum(pc.binary_length(whole.column(2)).to_numpy())
            at = 0
            while at < len(ends):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT_BYTES, "right")))
                yield _parcels(whole.slice(at, upto - at), order, length, slots, kind)
                at = upto

    parts = max(1, min(shards, MOST_PARTITIONS))
    # contiguous ranges of shards: shard s goes to partition s * parts / shards
    part = F.floor(F.col("shard") * F.lit(parts) / F.lit(max(1, shards))).cast("int")
    parcels = placed.mapInArrow(cut, "shard long, pieces binary, ids binary")
    dealt = parcels.repartitionById(parts, part).sortWithinPartitions("shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _ShardWriter(folder, total, length, slots, kind, end)
        for b in batches:
            for shard, pieces, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out.shard is not None and shard != out.shard:
                    yield out.finish(order=Permutation(n, key))
                out.add(shard, pieces, ids)
        if out.shard is not None:
            yield out.finish(order=Permutation(n, key))

    done = dealt.mapInArrow(write, "slot long, shard long, offset long, sequence long, first_doc_id long, n_tokens long, ids_sha256 string")
    # written once, whatever is asked of the result later
    done = stage(done, "sequences")
    _sweep(folder)
    return done


def _parcels(b: pa.RecordBatch, order: Permutation, length: int, slots: int, kind: str) -> pa.RecordBatch:
    """The pieces of all documents of a batch (id, start, ids), as one row for each shard."""
    width = np.dtype(kind).itemsize
    n = pc.binary_length(b.column(2)).to_numpy().astype(np.int64) // width
    start = b.column(1).to_numpy()
    first, last = start // length, (start + n - 1) // length
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    seq = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    begin = np.maximum(seq * length, start[doc])
    size = np.minimum((seq + 1) * length, (start + n)[doc]) - begin
    # where a piece stands among the ids of all documents of the batch, one after the other
    where = (np.cumsum(n) - n)[doc] + begin - start[doc]
    slot = order.slots(seq)
    shard = slot // slots
    by = np.argsort(shard, kind="stable")
    ids = np.frombuffer(b"".join(b.column(2).to_pylist()), kind)
    pieces = np.zeros(len(doc), PIECE)
    pieces["slot"], pieces["at"], pieces["n"] = slot % slots, begin - seq * length, size
    pieces["doc"], pieces["null"] = pc.fill_null(b.column(0), 0).to_numpy()[doc], b.column(0).is_null().to_numpy(zero_copy_only=False)[doc]
    found, at = np.unique(shard[by], return_index=True)
    z, rows = zstandard.ZstdCompressor(level=3), []
    for of in np.split(by, at[1:]) if len(by) else []:
        rows.append((z.compress(pieces[of].tobytes()), z.compress(b"".join([ids[w : w + k].tobytes() for w, k in zip(where[of].tolist(), size[of].tolist(), strict=True)]))))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["shard", "pieces", "ids"])


class _ShardWriter:
    """Takes the parcels of one shard at a time in any order; pieces that repeat one are left out, missing ones are an error."""

    def __init__(self, folder: str, total: int, length: int, slots: int, kind: str, end: int):
        self.fs, self.path = _file_system(folder)
        self.total, self.length, self.slots, self.kind, self.end = total, length, slots, np.dtype(kind), end
        self.shard: int | None = None

    def add(self, shard: int, pieces: bytes, ids: bytes) -> None:
        if self.shard is None:
            self.shard, self.heads = shard, []
            self.held = min(self.slots, -(-self.total // self.length) - shard * self.slots)
            self.buffer = np.full(self.held * self.length, self.end, self.kind)
        z = zstandard.ZstdDecompressor()
        heads, tokens = np.frombuffer(z.decompress(pieces), PIECE), np.frombuffer(z.decompress(ids), self.kind)
        self.heads.append(heads)
        at = (heads["slot"].astype(np.int64) * self.length + heads["at"]).tolist()
        begin = 0
        for to, n in zip(at, heads["n"].tolist(), strict=True):
            self.buffer[to : to + n] = tokens[begin : begin + n]
            begin += n

    def finish(self, order: Permutation) -> pa.RecordBatch:
        """Writes the shard; a row for each of its sequences."""
        base = self.shard * self.slots
        slot = np.arange(self.held, dtype=np.int64)
        sequence = order.sequences(base + slot)
        want = np.minimum(self.length, self.total - sequence * self.length)
        heads = np.unique(np.concatenate(self.heads))  # by slot, then place
        last = np.r_[heads["slot"][1:] != heads["slot"][:-1], True]
        upto = heads["at"] + heads["n"]
        first = np.r_[True, last[:-1]]
        follows = np.r_[0, upto[:-1]]
        if not ((heads["at"] == np.where(first, 0, follows)).all() and np.array_equal(heads["slot"][last], slot) and np.array_equal(upto[last], want)):
            raise RuntimeError(f"pieces of shard {self.shard} are missing or overlap")
        temp, name = f"{self.path}/.{self.shard:08d}-{uuid.uuid4().hex}", f"{self.path}/shard-{self.shard:08d}.bin"
        with self.fs.open_output_stream(temp) as f:
            f.write(memoryview(self.buffer).cast("B"))
        self.fs.move(temp, name)
        stride = self.length * self.kind.itemsize
        data = memoryview(self.buffer).cast("B")
        shas = [hashlib.sha256(data[i * stride : (i + 1) * stride]).hexdigest() for i in range(self.held)]
        docs = pa.array(heads["doc"][first], pa.int64(), mask=heads["null"][first])
        columns = [pa.array(base + slot), pa.array(np.full(self.held, self.shard), pa.int64()), pa.array(slot * stride), pa.array(sequence), docs, pa.array(want, pa.int64()), pa.array(shas, pa.string())]
        self.shard = None
        return pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "offset", "sequence", "first_doc_id", "n_tokens", "ids_sha256"])


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """Spark's s3a and s3n addresses are s3 here."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def _sweep(folder: str) -> None:
    """Removes what lost attempts of finished tasks left behind."""
    where, path = _file_system(folder)
    for info in where.get_file_info(fs.FileSelector(path)):
        if info.base_name.startswith(".") and info.is_file:
            where.delete_file(info.path)


def _put(folder: str, name: str, content: bytes) -> None:
    where, path = _file_system(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{name}") as f:
        f.write(content)


def read_slots(folder: str, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from slot `first` on: sequential reads, one seek to start or resume."""
    where, path = _file_system(folder)
    with where.open_input_stream(f"{path}/index.json") as f:
        index = json.loads(f.read())
    last = index["sequences"] if count is None else min(index["sequences"], first + count)
    slot = first
    while slot < last:
        shard, inside = divmod(slot, index["slots_per_shard"])
        with where.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(inside * index["stride"])
            for _ in range(min(last, (shard + 1) * index["slots_per_shard"]) - slot):
                yield np.frombuffer(f.read(index["stride"]), index["dtype"])
                slot += 1
