"""Phrase collocations mined from a prefix-free parse of the corpus.

A text is a sequence of words and piece ends. Where the hash of `longest - 1` tokens in a row hits a residue, a chunk begins; it reaches over
the first `longest - 1` tokens of the next one, and the text's end is padded with as many piece ends. Chunks begin where the content says so, so
texts that share a passage share its chunks, whatever stands before it. The parse is a dictionary of distinct chunks with
their frequencies (by language), summed up in the tasks before the shuffle.

Every n-gram of up to `longest` words lies whole in the chunk that its first token belongs to, and in the overlap of the one before it at most:
only n-grams that begin before the overlap are a chunk's own, so each occurrence counts once. n-grams are therefore counted in
distinct chunks alone, each weighted by its chunk's frequency.

An n-gram can be as frequent as a candidate only if both (n-1)-grams in it are. So 64-bit digests of words and bigrams are counted first (and of longer ones up
to longest - 1, level by level), in parcels of sorted digests by range; digests only serve to leave out what can't reach the least count, as a digest's count is never below that of
any of its n-grams. Then the words and n-grams whose digests (or those of both parts) are frequent, are counted by their strings, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage
from barloom.llm.shingles import mixed

#: A chunk begins about every EVERY tokens, and at most LONGEST_CHUNK after the one before.
EVERY, LONGEST_CHUNK = 64, 2048
#: Bytes of distinct chunks that a task holds, chunks of a batch, and tokens whose n-grams are counted at once (memory only; they have fewer than 2**21 words).
HELD_BYTES, BATCH_CHUNKS, BATCH_TOKENS = 16_000_000, 8_000, 250_000
#: Counts by digest that a task holds before it packs them, those it adds up at once, and those of a range of digests, about (memory only).
HELD_DIGESTS, ADDED_AT_ONCE, RANGE_DIGESTS = 1_500_000, 3_000_000, 2_000_000
#: Digests of frequent n-grams that are broadcast (8 bytes each, counted first); beyond, each batch of chunks gets those that it has by a shuffle.
BROADCAST_DIGESTS = 2_000_000
#: The mark of a piece's end; no byte of UTF-8. Blanks of the contract are space and tab.
END = b"\xff"
_TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words; starts over when it is large, which bounds memory only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Hashes()


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and END for each character that ends a piece. No word holds a space or END."""
    # all white space that split() knows is a blank or an end by now
    return text.translate(_TABLE).replace(END, b" \xff ").split()


def chunk_bounds(words: list[bytes], overlap: int, every: int = EVERY) -> np.ndarray:
    """Where chunks begin, and the end."""
    n = len(words)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        mix = np.zeros(max(0, n - overlap + 1), np.uint64)
        for i in range(overlap):
            mix = mixed(mix * _M + h[i : i + len(mix)])
    hits = np.flatnonzero(mix % np.uint64(every) == 0)
    ends = np.concatenate([[0], hits[hits > 0], [n]])
    if len(ends) > 1 and (np.diff(ends) > LONGEST_CHUNK).any():
        ends = np.concatenate([np.arange(a, b, LONGEST_CHUNK) for a, b in zip(ends[:-1], ends[1:], strict=True)] + [[n]])
    return ends


def parse(docs: DataFrame, longest: int, every: int = EVERY) -> DataFrame:
    """lang, chunk (its tokens, one space between), n: the dictionary of docs (lang, binary text)."""
    overlap = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["lang", "chunk", "n"]
            )

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                lang, words = lang.as_py(), tokens(text.as_py())
                if not words:
                    continue
                ends = chunk_bounds(words, overlap, every).tolist()
                words += [END] * overlap
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    key = (lang, b" ".join(words[x : y + overlap]))
                    had = held.get(key, 0)
                    held[key] = had + 1
                    if not had:
                        size += len(key[1]) + 100
                if size >= HELD_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return docs.mapInArrow(run, "lang string, chunk binary, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Known:
    """A set of digests: a table by their low bits turns most others away, a search in the sorted digests decides."""

    def __init__(self, digests: np.ndarray):
        self.sorted = digests
        self.mask = np.uint64((1 << min(24, max(10, (16 * len(digests)).bit_length()))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[digests.view(np.uint64) & self.mask] = True

    def has(self, digests: np.ndarray) -> np.ndarray:
        out = self.table[digests & self.mask]
        at = np.flatnonzero(out)
        if len(at):
            found = digests[at].view(np.int64)
            out[at] = self.sorted[np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)] == found
        return out


class _Batch:
    """Tokens of some chunks of one language, with their words' numbers and hashes."""

    def __init__(self, lang: str, chunks: list[tuple[list[bytes], int]], overlap: int):
        lengths = np.fromiter((len(w) for w, _ in chunks), np.int64, len(chunks))
        number = _Numbers({END: 0})
        self.ids = np.fromiter(map(number.__getitem__, chain.from_iterable(w for w, _ in chunks)), np.int64, lengths.sum())
        self.names = pa.array(list(number), pa.binary())
        seed = xxhash.xxh3_64_intdigest(lang)
        self.words = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in number), np.uint64, len(number))
        self.hashes = self.words[self.ids]
        self.owned = np.ones(len(self.ids), bool)
        for i in range(1, overlap + 1):
            self.owned[np.cumsum(lengths) - i] = False
        self.weights = np.repeat(np.fromiter((n for _, n in chunks), np.int64, len(chunks)), lengths)

    def levels(self, longest: int, known: _Known | None, known_levels: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n-grams of k = 1 to longest words: k, where those begin (in the overlap too) that have no end in them and may be frequent as far as known
        (digests of 1 to known_levels words) tells, and the digests of n-grams at all places."""
        n = len(self.ids)
        word = self.ids != 0
        whole, digest = word.copy(), self.hashes
        may = word & known.has(self.words)[self.ids] if known is not None else word
        yield 1, np.flatnonzero(may), digest
        for k in range(2, longest + 1):
            whole[: n - k + 1] &= word[k - 1 :]
            whole[n - k + 1 :] = False
            both = whole.copy()
            both[:-1] &= may[:-1] & may[1:]
            with np.errstate(over="ignore"):
                longer = np.zeros(n, np.uint64)
                longer[: n - k + 1] = mixed(digest[: n - k + 1] * _M + self.hashes[k - 1 :])
            digest, may = longer, both
            if known is not None and k <= known_levels:
                at = np.flatnonzero(both)
                may = np.zeros(n, bool)
                may[at[known.has(digest[at])]] = True
            yield k, np.flatnonzero(may), digest

    def phrases(self, k: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct n-grams of k words that begin at these tokens, and the sums of their weights."""
        key, width = self.ids[at], 1
        for j in range(1, k):
            # up to three numbers of 21 bits fill an integer; longer ones are numbered anew
            if width == 3:
                key, width = np.unique(key, return_inverse=True)[1], 1
            key, width = key << 21 | self.ids[at + j], width + 1
        first, sums = _summed(key, self.weights[at])
        words = [self.names.take(pa.array(self.ids[at[first] + j])) for j in range(k)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())), sums


def _summed(key: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and the sum of its weights."""
    order = np.argsort(key)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.empty(0, np.int64)
    return order[begins], np.add.reduceat(weights[order], begins) if len(key) else weights


def _pack(digests: np.ndarray, sums: np.ndarray) -> bytes:
    """Sorted digests as steps, and their counts, byte by byte of their places, compressed."""
    steps = np.diff(digests.view(np.uint64) ^ np.uint64(1 << 63), prepend=np.uint64(0))
    return zstandard.compress(b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (steps, sums)), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, 8, -1)
    steps, sums = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in both)
    return (np.cumsum(steps, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64), sums.astype(np.int64)


def _digests_at(batch: _Batch, levels: list[int], known: _Known | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted digests of n-grams of these levels, as far as their parts may be frequent, and their counts. Those of the overlap alone count 0:
    another batch counts them."""
    found = [(digest[at].view(np.int64), batch.weights[at] * batch.owned[at]) for k, at, digest in batch.levels(max(levels), known, min(levels) - 1) if k in levels]
    digests, weights = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    first, sums = _summed(digests, weights)
    return digests[first], sums


class _Counter:
    """What is made of each batch, and of what is left at a task's end."""

    def add(self, lang: str, number: int, batch: _Batch, known: _Known | None) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class _Parcels(_Counter):
    """Counts by digest, added up over a task's batches and packed by range of digests."""

    def __init__(self, levels: list[int], buckets: int):
        self.levels, self.held, self.size = levels, [], 0
        self.bounds = np.array([(i << 64) // buckets - (1 << 63) for i in range(1, buckets)], np.int64)

    def add(self, lang: str, number: int, batch: _Batch, known: _Known | None) -> Iterator[pa.RecordBatch]:
        digests, sums = _digests_at(batch, self.levels, known)
        self.held.append((digests[sums > 0], sums[sums > 0]))
        self.size += len(self.held[-1][0])
        if self.size >= HELD_DIGESTS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        digests, sums = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        first, sums = _summed(digests, sums)
        digests = digests[first]
        ends = [0, *np.searchsorted(digests, self.bounds).tolist(), len(digests)]
        full = [i for i in range(len(ends) - 1) if ends[i] < ends[i + 1]]
        parcels = [_pack(digests[ends[i] : ends[i + 1]], sums[ends[i] : ends[i + 1]]) for i in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(parcels, pa.binary())], names=["bucket", "data"])


class _Owners(_Counter):
    """The digests that each batch has, in the overlap too."""

    def __init__(self, levels: list[int]):
        self.levels = levels

    def add(self, lang: str, number: int, batch: _Batch, known: _Known | None) -> Iterator[pa.RecordBatch]:
        digests, sums = _digests_at(batch, self.levels, known)
        yield pa.RecordBatch.from_arrays([pa.array(digests), pa.repeat(pa.scalar(number, pa.int64()), len(sums))], names=["digest", "batch"])


def _frequent(parcels: DataFrame, least: int) -> DataFrame:
    """Digests whose counts reach least in all parcels together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            digests, sums = (np.concatenate(x) for x in zip(*held, strict=True))
            first, sums = _summed(digests, sums)
            return digests[first], sums

        def out() -> pa.RecordBatch:
            digests, sums = total()
            return pa.RecordBatch.from_arrays([pa.array(digests[sums >= least])], names=["digest"])

        for b in batches:
            for of, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if of != bucket and held:
                    yield out()
                    held, size = [], 0
                bucket = of
                held.append(_unpack(data.as_py()))
                size += len(held[-1][0])
                if size >= ADDED_AT_ONCE and len(held) > 1:
                    held = [total()]
                    size = len(held[0][0]) // 2  # as many again may come before the next sum
        if held:
            yield out()

    return parcels.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "digest long")


class _Phrases(_Counter):
    """Counts of the words and n-grams that may be frequent, by string, and of all words (as 0 words)."""

    def __init__(self, longest: int):
        self.longest = longest

    def add(self, lang: str, number: int, batch: _Batch, known: _Known | None) -> Iterator[pa.RecordBatch]:
        total = int(batch.weights[batch.owned & (batch.ids != 0)].sum())
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b""], pa.binary()), pa.array([0], pa.int32()), pa.array([total])], names=["lang", "phrase", "k", "n"])
        for k, at, _ in batch.levels(self.longest, known, max(2, self.longest - 1)):
            at = at[batch.owned[at]]
            if len(at):
                phrases, sums = batch.phrases(k, at)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(sums)), phrases, pa.repeat(pa.scalar(k, pa.int32()), len(sums)), pa.array(sums)], names=["lang", "phrase", "k", "n"])


def _scan(chunks: DataFrame, overlap: int, counter: Callable[[], _Counter], schema: str, known: DataFrame | None, owners: Callable[[], DataFrame]) -> DataFrame:
    """What a counter makes of each batch of chunks and the known digests: all of them, or those of owners() (batch, digest) where they are too many to broadcast."""

    def batches(rows: Iterator[tuple[str, bytes, int, int]], digests: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[list[bytes], int]]] = {}
        size, number, count = 0, None, counter()
        known = None if digests is None else _Known(digests)
        for lang, chunk, n, of in rows:
            if held and (of != number or size >= BATCH_TOKENS):
                for x, them in held.items():
                    yield from count.add(x, number, _Batch(x, them, overlap), known)
                held, size = {}, 0
            words, number = chunk.split(b" "), of
            held.setdefault(lang, []).append((words, n))
            size += len(words)
        for x, them in held.items():
            yield from count.add(x, number, _Batch(x, them, overlap), known)
        yield from count.rest()

    def rows_of(them: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int, int]]:
        for b in them:
            for row in zip(*(b.column(i) for i in range(4)), strict=True):
                yield tuple(x.as_py() for x in row)

    table = chunks.select("lang", "chunk", "n", "batch")
    if known is None:
        return table.mapInArrow(lambda them: batches(rows_of(them), None), schema)
    if known.count() <= BROADCAST_DIGESTS:
        all_known = chunks.sparkSession.sparkContext.broadcast(np.sort(known.toArrow()["digest"].to_numpy()))
        return table.mapInArrow(lambda them: batches(rows_of(them), all_known.value), schema)

    def of_batch(one: pa.Table, two: pa.Table) -> pa.Table:
        made = list(batches(rows_of(iter(one.to_batches())), np.unique(two["digest"].to_numpy())))
        kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
        return pa.Table.from_batches(made, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]))

    return table.groupBy("batch").cogroup(owners().groupBy("batch")).applyInArrow(of_batch, schema)


def count_grams(chunks: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase (binary), k (words), n: occurrences of all n-grams of 1 to longest words that have least or more (and of some others), and with k = 0 the
    number of all words. chunks: lang, chunk, n, batch (a number that BATCH_CHUNKS chunks or so share)."""
    overlap, known = longest - 1, None
    # as many ranges as have about RANGE_DIGESTS counts each
    buckets = max(16, chunks.count() * EVERY // RANGE_DIGESTS)
    levels: list[tuple[DataFrame, DataFrame]] = []

    def owners() -> DataFrame:
        """The known digests that each batch has; its chunks are read again for them."""
        return reduce(DataFrame.unionAll, [rows.join(often, "digest", "left_semi").select("batch", "digest") for rows, often in levels])

    for here in [[1, 2], *[[k] for k in range(3, longest)]]:
        parcels = _scan(chunks, overlap, partial(_Parcels, here, buckets), "bucket int, data binary", known, owners)
        often = stage(_frequent(parcels, least), "often")
        rows = _scan(chunks, overlap, partial(_Owners, here), "digest long, batch long", known, owners)
        levels.append((rows, often))
        known = often if known is None else known.unionAll(often)
    grams = _scan(chunks, overlap, partial(_Phrases, longest), "lang string, phrase binary, k int, n long", known, owners)
    return grams.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 * a^2 / (left * right)), exact up to 38 digits: counts may reach 10^15."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (left * right).cast("decimal(38,0)"))


def mine(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, first: int = 2000, text: str = "text", lang: str = "lang", every: int = EVERY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of 2 to longest words of each language.

    Null texts are empty, a null lang is 'und'. Pieces end at . , ; : ! ? and line ends; words are runs without space and tab, A-Z lower-cased. a counts a
    phrase's occurrences within pieces (least or more), l and r those of its two parts at the cut with the lowest score
    floor(1,000,000 * a^2 / (l * r)), ties to the shortest first part; n is the number of all words. Candidates that stand inside a longer
    candidate with at least inside_percent of their occurrences go. Ties rank by a, then by phrase in byte order. Every row is a text of its own,
    repeats included; long texts are parsed whole; columns other than these two are not read; languages without candidates and an empty table
    give no rows.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    read = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    chunks = stage(parse(read, longest, every).withColumn("batch", F.floor(F.monotonically_increasing_id() / BATCH_CHUNKS)), "chunks")
    counted = count_grams(chunks, longest, least)
    # the parts of a candidate are at least as frequent as it is, so nothing below the least count is needed but the number of words
    counted = stage(counted.where((F.col("n") >= least) | (F.col("k") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "k", "n"), "counted")
    words = counted.where("k = 0").select("lang", F.col("n").alias("words"))
    often = counted.where("k > 0")
    candidates = often.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("one"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("two"))
    for side, count in (("one", "l"), ("two", "r")):
        cuts = cuts.join(often.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("at"))
    best = best.select("lang", "phrase", "at.a", "at.l", "at.r", "at.score")

    def inner(size: int) -> DataFrame:
        """Phrases of that many words inside each longer candidate, with its count."""
        inside = F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: part(i, F.lit(size)))
        return candidates.where(F.col("k") > size).select("lang", F.col("n").alias("most"), F.explode(inside).alias("phrase"))

    longer = [inner(size) for size in range(2, longest)]
    if longer:
        around = reduce(DataFrame.unionAll, longer).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        best = best.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
