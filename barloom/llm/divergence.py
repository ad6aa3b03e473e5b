"""Source divergence audit with late string materialisation.

How much each source's term rates differ from those of the other sources of its language, and which terms it overuses.

One pass over the texts writes, for each chunk of a task and term of a language, the number of documents and the occurrences by group; this is the only
table that has strings. From then on the shuffles read its fixed-width columns only: a term is the 64-bit digest of language and term, a group
(language and source) another. For digests that reach the least number of documents, the smallest and largest (language, term) are compared:
where they differ, the digest stands for several terms, which are numbered by string and counted apart as (digest, number), so that results are exact
whatever the digests. A digest's documents are never fewer than those of any of its terms, so no term is lost before that. Strings are joined
back for the terms that may be among a group's first ones, and for no others.

Divergences of all pairs of sources (which are rows of the result) come from blocks of terms: a block is a matrix of some terms by up to two sides of
SIDE sources, every pair's part of it is summed up at once, and only sums leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage

SCALE = 1_000_000_000
#: Terms, counts and tokens that a task holds, and bytes of a text that it cuts up at once (memory only).
TERMS, COUNTS, TOKENS, SLICE = 400_000, 1_500_000, 1_000_000, 4_000_000
#: Digests that are broadcast (8 bytes each, counted first); beyond, they are joined by a shuffle.
BROADCAST_DIGESTS = 2_000_000
#: Cells of a block of terms by sources, about (memory only), and sources in one side of a block.
CELLS, SIDE = 1 << 19, 512
#: A-Z lower-cased, ASCII that is no letter taken as a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GROUP_BITS = 24


class _Ids(dict):
    """Numbers of the terms of one language, given as they come."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        self.lang, self.names = lang, names

    def __missing__(self, term: bytes) -> int:
        i = self[term] = len(self.names)
        self.names.append((self.lang, term))
        return i


class _Chunk:
    """Counts of some texts of a task."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bytes]] = []
        self.ids: dict[str, _Ids] = {}
        self.groups: dict[int, int] = {}
        self.keys, self.sums = np.empty(0, np.int64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.n_held, self.n_docs = 0, np.empty(0, np.int64)

    def add(self, lang: str, group: int, text: bytes) -> None:
        ids = self.ids.get(lang)
        if ids is None:
            ids = self.ids[lang] = _Ids(lang, self.names)
        g = self.groups.setdefault(group, len(self.groups))
        text, at, parts = text.translate(_TABLE), 0, []
        while at < len(text):
            upto = text.find(b" ", at + SLICE) if at + SLICE < len(text) else len(text)
            upto = len(text) if upto < 0 else upto
            words = text[at:upto].split()
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            at = upto
        if parts:
            of = np.concatenate(parts)
            self.held.append(of << _GROUP_BITS | g)
            self.docs.append(np.unique(of))
            self.n_held += len(of)
            if self.n_held >= TOKENS:
                self.compact()

    def compact(self) -> None:
        new, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.held]), return_counts=True)
        keys = np.concatenate([self.keys, new])
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], np.concatenate([self.sums, counts])[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.sums = keys[begins], np.add.reduceat(sums, begins) if len(keys) else sums
        of = np.concatenate([np.empty(0, np.int64), *self.docs])
        self.n_docs = np.bincount(of, minlength=len(self.names)) + np.pad(self.n_docs, (0, len(self.names) - len(self.n_docs)))
        self.held, self.docs, self.n_held = [], [], 0

    def full(self) -> bool:
        return len(self.names) >= TERMS or len(self.keys) >= COUNTS or len(self.groups) >= (1 << _GROUP_BITS) - 1

    def out(self, mask: int) -> pa.RecordBatch:
        self.compact()
        groups = np.fromiter(self.groups, np.int64, len(self.groups))
        terms, of = self.keys >> _GROUP_BITS, self.keys & ((1 << _GROUP_BITS) - 1)
        offsets = np.searchsorted(terms, np.arange(len(self.names) + 1))  # every term has a count
        cells = pa.StructArray.from_arrays([pa.array(groups[of]), pa.array(self.sums)], names=["group", "n"])
        digests = np.fromiter((xxhash.xxh3_64_intdigest(t, xxhash.xxh3_64_intdigest(lang)) for lang, t in self.names), np.uint64, len(self.names))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in self.names], pa.string()), pa.array([x[1] for x in self.names], pa.binary()),
                pa.array((digests & np.uint64(mask)).view(np.int64)), pa.array(self.n_docs.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells),
            ],
            names=["lang", "term", "digest", "docs", "cells"],
        )


def _counted(docs: DataFrame, digest_bits: int) -> DataFrame:
    """docs: lang, group, text (binary). lang, term, digest, docs (documents), cells (occurrences by group), added up within chunks."""
    mask = (1 << digest_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for b in batches:
            for lang, group, text in zip(*(b.column(i) for i in range(3)), strict=True):
                chunk.add(lang.as_py(), group.as_py(), text.as_py())
                if chunk.full():
                    yield chunk.out(mask)
                    chunk = _Chunk()
        if chunk.names:
            yield chunk.out(mask)

    return docs.mapInArrow(run, "lang string, term binary, digest long, docs long, cells array<struct<group:long,n:long>>")


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)), exact beyond 64 bits; null if no term is kept."""
    whole = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2), F.nullif(whole(total + 2 * v), whole(F.lit(0)))) + 1


def diverge(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers up to SCALE + 1."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, first: int = 10, text: str = "text", lang: str = "lang", source: str = "source", digest_bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank. Every row of docs is a document; null text, lang and source read as ''. Columns other than
    these three are not read, whatever their names. The term table keeps, by lang, terms in least_docs documents or more.

    part 'pair': for every group (lang, source) and each other source of the lang, the divergence summed over all kept terms (0 if
    none is kept). part 'term': the `first` terms of a group that have occurrences there and a larger share than in the lang.
    Groups whose texts are empty have shares of count 0. Ties rank by item in byte order. An empty table gives no rows. Long texts are counted whole;
    text that isn't valid UTF-8 counts by its bytes. digest_bits is for tests: with few bits most digests collide, which changes no result.
    """
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    groups, seed = _groups(read)
    counted = stage(_counted(read.select("lang", F.xxhash64(F.lit(seed), "lang", "source"), "text"), digest_bits), "counted")

    # digests of enough documents, and the strings they stand for
    frequent = stage(counted.groupBy("digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("digest"), "frequent")
    few = frequent.count() <= BROADCAST_DIGESTS
    known = F.broadcast(frequent) if few else frequent
    name = F.struct("lang", "term")
    named = counted.select("digest", "lang", "term").join(known, "digest", "left_semi").groupBy("digest").agg(F.min(name).alias("low"), F.max(name).alias("high"))
    named = stage(named, "named")
    clashing = named.where("low <> high").select("digest")
    several = counted.join(clashing, "digest", "left_semi").groupBy("digest", "lang", "term").agg(F.sum("docs").alias("docs"))
    several = several.withColumn("sub", F.row_number().over(Window.partitionBy("digest").orderBy("lang", "term"))).where(F.col("docs") >= least_docs)
    several = stage(several.select("digest", "lang", "term", "sub"), "several")
    names = named.where("low = high").select("digest", F.lit(0).alias("sub"), "low.lang", "low.term").unionByName(several)

    # occurrences of the kept terms by group: digests, groups and numbers; strings are read again for clashing digests only
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"))
    flat = lambda df, *keys: df.select(*keys, F.inline("cells"))
    single = named.where("low = high").select("digest")
    digests = counted.select("digest", "cells")
    if few:
        plain = summed(flat(digests.join(F.broadcast(single), "digest", "left_semi"), "digest"), "digest", "group")
    else:
        plain = summed(flat(digests, "digest"), "digest", "group").join(single, "digest", "left_semi")
    apart = summed(flat(counted.join(several, ["digest", "lang", "term"]), "digest", "sub"), "digest", "sub", "group")
    cells = plain.withColumn("sub", F.lit(0)).unionByName(apart)
    cells = stage(cells.join(groups, "group").select("lang", "source", "digest", "sub", "n"), "cells")

    kept = names.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(kept, "lang", "left").join(sums, ["lang", "source"], "left")
    totals = stage(totals.select("lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("total", F.lit(0)).cast("long").alias("total")), "totals")
    pairs = _pairs(totals, cells)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = _terms(totals, cells, names.drop("lang"), first)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _groups(read: DataFrame) -> tuple[DataFrame, int]:
    """group (a hash), lang, source of every group that occurs, and the first seed for which no two groups share a hash."""
    pairs = stage(read.select("lang", "source").distinct(), "pairs")
    for seed in range(16):
        groups = pairs.select(F.xxhash64(F.lit(seed), "lang", "source").alias("group"), "lang", "source")
        if groups.groupBy("group").count().where("count > 1").isEmpty():
            break
    return groups, seed


def _terms(groups: DataFrame, cells: DataFrame, names: DataFrame, first: int) -> DataFrame:
    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("v").alias("lv"))
    whole = cells.groupBy("lang", "digest", "sub").agg(F.sum("n").alias("ln")).join(by_lang, "lang")
    whole = whole.select("lang", "digest", "sub", _share(F.col("ln"), F.col("all"), F.col("lv")).alias("q"))
    own = cells.join(groups, ["lang", "source"]).select("lang", "source", "digest", "sub", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    over = own.join(whole, ["lang", "digest", "sub"]).where("p > q").select("lang", "source", "digest", "sub", diverge(F.col("p"), F.col("q")).alias("value"))
    over = stage(over, "over")
    # the first values of each group, then all terms that reach the last of them: their strings decide ties
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    bar = over.select("lang", "source", "value").withColumn("place", place).where(F.col("place") <= first)
    bar = bar.groupBy("lang", "source").agg(F.min("value").alias("bar"))
    chosen = over.join(bar, ["lang", "source"]).where("value >= bar").join(names, ["digest", "sub"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return chosen.select("lang", "source", F.col("term").cast("string").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= first)


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang), value. The result itself has a row for every pair of sources."""
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    ordered = groups.select("lang", "source", number.alias("i"), "total", "v", _share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("p0"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.first("v").alias("lv"))
    sizes = sizes.select("lang", F.ceil(F.col("sources") / SIDE).cast("int").alias("sides"), F.greatest(F.ceil(F.col("lv") * F.least("sources", F.lit(2 * SIDE)) / CELLS), F.lit(1)).cast("int").alias("blocks"))
    ordered = stage(ordered.join(sizes, "lang").withColumn("side", F.floor(F.col("i") / SIDE).cast("int")), "sources")

    def dealt(df: DataFrame) -> DataFrame:
        """Rows of a side go to each pair of sides that has it."""
        with_other = df.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        return with_other.withColumns({"low": F.least("side", "with"), "high": F.greatest("side", "with")}).drop("with", "sides", "blocks")

    p = _share(F.col("n"), F.col("total"), F.col("v")).alias("p")
    block = F.pmod(F.xxhash64("digest", "sub"), F.col("blocks")).cast("int").alias("block")
    shares = cells.join(ordered, ["lang", "source"]).select("lang", "i", "side", "sides", "blocks", block, "digest", "sub", p)
    # aliases tell these columns from those that shares got from the same table
    sources = ordered.select(*[F.col(c).alias(c) for c in ("lang", "i", "side", "sides", "blocks", "p0")], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    unit = ["lang", "low", "high", "block"]
    sums = dealt(shares).groupBy(*unit).cogroup(dealt(sources).groupBy(*unit)).applyInPandas(_block, "lang string, a int, b int, value long, terms long")
    sums = stage(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")), "sums")
    one = ordered.select("lang", F.col("i").alias("x"), "source", "v", F.col("p0").alias("p"))
    two = ordered.select("lang", F.col("i").alias("y"), F.col("source").alias("item"), F.col("p0").alias("q"))
    pairs = one.join(two, "lang").where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    # terms that no source of both sides has count as absent in both
    value = F.coalesce("value", F.lit(0)) + F.coalesce((F.col("v") - F.coalesce("terms", F.lit(0))) * diverge(F.col("p"), F.col("q")), F.lit(0))
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))


def _block(key: tuple, shares: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Divergence over the terms of one block, of each source of one side and each of the other (once, if the sides are the same), and the
    number of these terms."""
    lang, low, high, _ = key
    empty = pd.DataFrame({"lang": pd.Series([], dtype=object), "a": np.empty(0, np.int32), "b": np.empty(0, np.int32), "value": np.empty(0, np.int64), "terms": np.empty(0, np.int64)})
    if not len(shares):
        return empty
    sources = sources.sort_values("i")
    ids, base = sources["i"].to_numpy(), sources["p0"].to_numpy(np.int64)
    terms = pd.factorize(pd.MultiIndex.from_frame(shares[["digest", "sub"]]))[0]
    held = np.tile(base, (terms.max() + 1, 1))
    held[terms, np.searchsorted(ids, shares["i"].to_numpy())] = shares["p"].to_numpy(np.int64)
    first, second = (np.flatnonzero(sources["side"].to_numpy() == s) for s in (low, high))
    parts = []
    for x in first:
        others = second[second > x]
        if not len(others):
            continue
        p, q = held[:, [x]], held[:, others]
        value = ((p - q) ** 2 // (p + q)).sum(axis=0)
        parts.append(pd.DataFrame({"lang": lang, "a": ids[x], "b": ids[others], "value": value, "terms": len(held)}))
    return pd.concat(parts) if parts else empty
