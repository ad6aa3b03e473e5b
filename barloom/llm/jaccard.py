"""Exact Jaccard self-join of word-shingle sets with set-relation skipping.

Rows with equal sets are one node, found by a 128-bit digest. Nodes are indexed by the prefix of their
tokens under one global order, rare tokens first: two sets that reach the threshold share a prefix token.

Skipping in the index. A token's list is cut into blocks by the position-bounded prefix and by band of set
size; a set meets only the blocks of its own band and the next, and a pair is given up unless its first common
positions and the number of common prefix tokens leave room for the overlap it needs. (Of two prefixes, the
one that ends first holds at least prefix - (size - overlap) common tokens, all of them in the other prefix too.)

Skipping between sets. A set that links with a central set of its lists (its pivot) is absorbed: it is
represented by the pivot in all lists, so that a group of n near copies costs n comparisons with its pivot,
not n * n. Lists then hold owners, not sets. When two owners come up as candidates, they are compared first; if they
link, their clusters are connected and nothing else is needed. If not, the answers of an absorbed set x
follow from its pivot's: |x ^ y| >= |p ^ q| - |x ^ p| - |y ^ q| rules out most members without reading their sets,
and the rest are compared exactly, in rounds of growing parts of both clusters: once a link between two clusters is found, they
are connected and need no more. So no component is lost, while links within a cluster are never listed.

A pivot of many near copies is a hot key: pairs of a set that has more than PAIRS_A_TASK of them are dealt to several copies of it.

The rare-first order comes from counters of tokens that repeat within chunks of a task, hashed into
2**SKETCH_BITS buckets, over all documents. Any order gives the same links; this one only makes lists short.
The counters, reduced to a byte each, are the one thing broadcast: 2**SKETCH_BITS bytes whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage
from barloom.llm.components import components
from barloom.llm.shingles import set_digest, shingle_set

SKETCH_BITS, BLOCK_BITS = 22, 16
#: Tokens that a task sorts at once to find repeated ones (8 MB).
CHUNK = 1_000_000
#: Ids of sets to compare are broadcast up to so many (about 16 bytes each), and joined by shuffle beyond.
BROADCAST_IDS = 2_000_000
#: Pairs of one set that meet in a task, about; members of each of two clusters that are compared first, and the growth of that part.
PAIRS_A_TASK, FIRST_MEMBERS, GROWTH = 250, 64, 8


def join_groups(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set), component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles (A-Z
    lower-cased; a text of fewer words is one shingle). component_id is the smallest doc_id reachable by links,
    the document itself included. Null texts and texts without words have an empty set and link with nothing.
    Rows with a null doc_id keep a null component and link with nothing. Rows that repeat a doc_id are one
    document: they share a component whatever their texts. doc_id holds whole numbers, or text of such; other text is an error.
    Ties at the threshold link. Long texts are compared by their whole sets. Columns other than these two are not read, whatever
    their names; an empty table gives no rows.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body"))
    signed = stage(_signatures(src, k), "signatures")
    rows = signed.where("block is null").select("doc", "n", "h1", "h2")
    order = _token_order(signed.where("block is not null").select("block", "counts"))
    known = rows.where("doc is not null")
    classes = stage(known.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.first("n").alias("n")), "classes")
    links = _links(src, classes, order, k, percent)
    # an id with several texts joins the classes of all of them
    several = known.where("n > 0").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b < c")
    links = links.unionAll(several.select(F.col("b").alias("a"), F.col("c").alias("b")))
    found = components(links)
    named = stage(classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component")), "named")
    out = rows.join(named.withColumnsRenamed({"h1": "g1", "h2": "g2"}), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id")
    )


# --- tokens and their order


def _signatures(src: DataFrame, k: int) -> DataFrame:
    """Size and digest of every set; after a task's last row, its counters of repeated tokens by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        held: list[np.ndarray] = []
        n_held = 0

        def flush() -> None:
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            again = count > 1
            np.add.at(counters, tokens[again] & ((1 << SKETCH_BITS) - 1), count[again].astype(np.uint32))

        for b in batches:
            sizes, digests = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, k)
                sizes.append(len(s))
                digests.append(set_digest(s))
                held.append(s)
                n_held += len(s)
                if n_held >= CHUNK:
                    flush()
                    held, n_held = [], 0
            n = len(sizes)
            whole = [b.column(0), pa.array(sizes, pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*whole, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if held:
            flush()
        blocks = counters.reshape(-1, 1 << BLOCK_BITS)
        full = [i for i in range(len(blocks)) if blocks[i].any()]
        zero = pa.array([0] * len(full), pa.int64())
        counts = pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), zero, zero, zero, pa.array(full, pa.int32()), counts], names=names)

    names = ["doc", "n", "h1", "h2", "block", "counts"]
    return src.mapInArrow(run, "doc long, n long, h1 long, h2 long, block int, counts binary")


def _token_order(counters: DataFrame) -> bytes:
    """A byte for each bucket of tokens: 0 for rare, more for more frequent. Its size is fixed."""
    # a block's counters meet in two steps, so that no task reads those of all tasks; each task adds them up as they come
    part = counters.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    ranked = _added(_added(part, ["block", "part"]), ["block"], ranked=True).collect()
    order = bytearray(1 << SKETCH_BITS)
    for r in ranked:
        order[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = r["counts"]
    return bytes(order)


def _added(counters: DataFrame, keys: list[str], ranked: bool = False) -> DataFrame:
    """The sum of the counters of each key, or the bytes of its ranks. A task holds one sum at a time."""

    def pack(total: np.ndarray) -> bytes:
        if ranked:
            return np.minimum(255, np.ceil(4 * np.log2(1 + total.astype(float)))).astype(np.uint8).tobytes()
        return zlib.compress(total.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([pack(total)], pa.binary())], names=[*keys, "counts"])
        for b in batches:
            for *of, c in zip(*(b.column(x) for x in (*keys, "counts")), strict=True):
                of, raw = [x.as_py() for x in of], zlib.decompress(c.as_py())
                if of != key:
                    if key is not None:
                        yield out()
                    key, total = of, np.zeros(1 << BLOCK_BITS, np.uint64)
                total += np.frombuffer(raw, np.uint32 if len(raw) == 4 << BLOCK_BITS else np.uint64)
        if key is not None:
            yield out()

    dealt = counters.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", counts binary")


def _prefix_size(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1  # n - ceil(percent * n / 100) + 1


def _overlap(nx: Column, ny: Column, percent: int) -> Column:
    """The least intersection of two sets of these sizes that reaches the threshold."""
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent) - F.lit(1e-9))


# --- candidates and links


def _links(src: DataFrame, classes: DataFrame, order: bytes, k: int, percent: int) -> DataFrame:
    spark = src.sparkSession
    weights = spark.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.frombuffer(weights.value, np.uint8)
        for b in batches:
            out = []
            for doc, t in zip(b["doc"], b["body"], strict=True):
                s = shingle_set(t, k)
                n = len(s)
                # a set that equals no other can link only if one element more or less is allowed
                if 100 * n < percent * (n + 1):
                    continue
                r = rank[s & ((1 << SKETCH_BITS) - 1)]
                first = np.lexsort((s, r))[: _prefix_size(n, percent)]
                out.append((doc, *set_digest(s), n, int(np.count_nonzero(r[first])) * 1_000_000 // len(first), s[first]))
            yield pd.DataFrame(out, columns=["doc", "h1", "h2", "n", "score", "prefix"])

    index = src.where("doc is not null").mapInPandas(prefixes, "doc long, h1 long, h2 long, n long, score long, prefix array<long>")
    reps = classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "node")
    sets = index.join(reps, (F.col("doc") == F.col("node")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_semi")
    sets = stage(sets.select("doc", "n", "score", "prefix"), "prefixes")
    posts = sets.select("doc", "n", "score", F.posexplode("prefix").alias("pos", "token"))

    # lists of two or more, and the most central set of each: the one with the fewest rare tokens
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("score", "doc")).alias("pivot")).where("size > 1")
    lists = stage(lists.select("token", F.col("pivot.doc").alias("pivot"), F.col("pivot.score").alias("pivot_score")), "lists")
    posts = stage(posts.join(lists, "token").select("token", "doc", "n", "pos", "pivot", "pivot_score"), "posts")
    small = sets.select("doc", "n", "prefix", "score")

    # each set is compared with one pivot first, the one it meets in most lists; all other pairs come later
    stars = posts.where("doc <> pivot").groupBy(F.col("doc").alias("x"), F.col("pivot").alias("y")).agg(F.count(F.lit(1)).alias("met"), F.first("pivot_score").alias("score"))
    stars = stars.groupBy("x").agg(F.max(F.struct("met", "score", "y"))["y"].alias("y"))
    first = stage(_verified(src, _filtered(stars, small, percent), k, percent), "stars")
    linked = first.where("linked")
    # pivots stand for the sets that link with them, unless they hang on another pivot themselves
    roots = linked.select(F.col("y").alias("doc")).distinct().join(linked.select(F.col("x").alias("doc")), "doc", "left_anti")
    absorbed = linked.join(roots, F.col("y") == F.col("doc"), "left_semi").groupBy("x").agg(F.min(F.struct("apart", "y")).alias("own"))
    owners = stage(absorbed.select(F.col("x").alias("doc"), F.col("own.y").alias("owner"), F.col("own.apart").alias("away")), "owners")

    # owners meet in the lists' blocks; bands are such that sets that can link lie in the same or the next
    owned = posts.join(owners, "doc", "left").select("token", F.coalesce("owner", "doc").alias("owner"), "n", "pos")
    owned = owned.groupBy("token", "owner").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"))
    band = lambda c: F.floor(F.log(F.col(c)) / float(np.log(100 / percent)) + 1e-9).cast("long")
    blocks = owned.withColumn("block", F.explode(F.sequence(band("low"), band("high"))))
    blocks = stage(blocks, "blocks")
    crowded = blocks.groupBy("token").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("token")
    blocks = stage(blocks.join(crowded, "token", "left_semi"), "crowded")
    left = blocks.select("token", F.col("block").alias("at"), F.col("owner").alias("x"), F.col("low").alias("xl"), F.col("high").alias("xh"), F.col("pos").alias("xp"))
    right = blocks.select(F.col("token").alias("token_y"), F.col("block").alias("own"), F.explode(F.array("block", F.col("block") - 1)).alias("at"), F.col("owner").alias("y"), F.col("low").alias("yl"), F.col("high").alias("yh"), F.col("pos").alias("yp"))
    # sizes must fit, and the place of a common token must leave room for the overlap: of the tokens that two sets share,
    # at least the first does. Within a block each pair meets once.
    sizes = (F.col("x") != F.col("y")) & (100 * F.col("xh") >= percent * F.col("yl")) & (100 * F.col("yh") >= percent * F.col("xl"))
    room = (F.col("xp") <= F.col("xh") - _overlap(F.col("xh"), F.col("yl"), percent)) & (F.col("yp") <= F.col("yh") - _overlap(F.col("yh"), F.col("xl"), percent))
    once = (F.col("x") < F.col("y")) | (F.col("at") != F.col("own"))
    met = left.join(right.withColumnRenamed("at", "at_y"), (F.col("token") == F.col("token_y")) & (F.col("at") == F.col("at_y")) & sizes & room & once)
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = pairs.join(first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    # two single sets also need enough common prefix tokens; clusters are compared in any case
    heads = owners.select(F.col("owner").alias("h"), F.lit(True).alias("is_head")).distinct()
    second = stage(_verified(src, _filtered(pairs, small, percent, heads), k, percent), "second")

    # clusters whose owners do not link: members that the triangle inequality cannot rule out
    known = second.unionByName(first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "apart", "linked")).where("not linked")
    clustered = known.join(heads, F.col("x") == F.col("h"), "left_semi").unionByName(known.join(heads, F.col("y") == F.col("h"), "left_semi")).distinct()
    clustered = stage(clustered.select("x", "y", "apart"), "clustered")
    members = small.join(owners, "doc", "left").select(F.coalesce("owner", "doc").alias("owner"), "doc", F.coalesce("away", F.lit(0)).alias("away"), "n")
    # two sets x, y that link are apart by (n_x + n_y) * slack at most, so their pivots by what both reach
    slack = (100 - percent) / (100 + percent)
    members = members.withColumn("reach", F.col("away") + F.col("n") * F.lit(slack) + 1e-6)
    sizes = members.groupBy("owner").agg(F.count(F.lit(1)).alias("size"), F.max("reach").alias("top"))
    # a member's place in a random order of its cluster, about
    place = F.shiftrightunsigned(F.xxhash64("doc"), 11).cast("double") / float(1 << 53) * F.col("size")
    members = stage(members.join(sizes, "owner").select("owner", "doc", "away", "n", "reach", "size", "top", place.alias("place")), "members")
    tops = members.groupBy("owner").agg(F.max("top").alias("top"), F.max("size").alias("size"))
    for c in "xy":
        clustered = clustered.join(tops.select(F.col("owner").alias(c), F.col("top").alias(f"{c}_top"), F.col("size").alias(f"{c}_size")), c)
    clustered = stage(clustered.where(F.col("apart") <= F.col("x_top") + F.col("y_top")), "near")
    ends = lambda df: df.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = [ends(first), ends(second), *(ends(df) for df in _between(src, clustered, members, small, k, percent))]
    return stage(reduce(DataFrame.unionAll, found), "found")


def _between(src: DataFrame, clustered: DataFrame, members: DataFrame, small: DataFrame, k: int, percent: int) -> Iterator[DataFrame]:
    """Compared pairs of members of clusters whose owners (x, y, apart) do not link. Each round takes GROWTH times as many members of
    each cluster as the one before, and pairs of clusters that are linked by then take no part."""
    largest = clustered.agg(F.max(F.greatest("x_size", "y_size"))).first()[0]
    if largest is None:
        return
    low, high = 0, FIRST_MEMBERS
    while True:
        part = members.where(F.col("place") < high) if high < largest else members
        one, two = (part.select(*[F.col(v).alias(f"{c}_{v}") for v in ("owner", "doc", "away", "n", "reach", "place")]) for c in "xy")
        most = F.col("x_n") + F.col("y_n") - 2 * _overlap(F.col("x_n"), F.col("y_n"), percent)
        near = (F.col("apart") - F.col("x_away") - F.col("y_away") <= most) & (F.greatest("x_place", "y_place") >= low)
        rest = clustered.join(one, (F.col("x") == F.col("x_owner")) & (F.col("x_reach") + F.col("y_top") >= F.col("apart")))
        rest = rest.join(two, (F.col("y") == F.col("y_owner")) & near)
        rest = rest.where("x_doc <> x or y_doc <> y").select(F.col("x_doc").alias("x"), F.col("y_doc").alias("y")).distinct()
        compared = _verified(src, _filtered(rest, small, percent), k, percent)
        if high >= largest:
            yield compared
            return
        compared = stage(compared, "compared")
        yield compared
        owner = lambda c: members.select(F.col("doc").alias(c), F.col("owner").alias(f"{c}_owner"))
        done = compared.where("linked").join(owner("x"), "x").join(owner("y"), "y")
        done = done.select(F.least("x_owner", "y_owner").alias("x"), F.greatest("x_owner", "y_owner").alias("y")).distinct()
        clustered = stage(clustered.join(done, ["x", "y"], "left_anti"), "clustered")
        low, high = high, high * GROWTH
        if clustered.isEmpty():
            return


def _meet(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (x, y, a plain table) with the given columns of the rows of sets (by doc) of both. One set may be in most pairs: one
    in more than PAIRS_A_TASK is copied, and each of its pairs meets one of the copies."""
    often = lambda c: pairs.groupBy(F.lit(c).alias("end"), F.col(c).alias("hot")).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).alias("copies"))
    hot = stage(often("x").unionAll(often("y")).where("copies > 1"), "hot")
    some = {r[0] for r in hot.select("end").distinct().collect()}
    for c, other in ("xy", "yx"):
        named = sets.select(F.col("doc").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in columns])
        if c not in some:
            pairs = pairs.join(named, c)
            continue
        of = hot.where(F.col("end") == c).select("hot", "copies")
        match = F.col(c) == F.col("hot")
        salted = pairs.join(of, match).withColumn("salt", F.pmod(F.xxhash64(F.col(other)), F.col("copies"))).drop("hot", "copies")
        copied = named.join(of, match).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("hot", "copies")
        pairs = pairs.join(of, match, "left_anti").join(named, c).unionByName(salted.join(copied, [c, "salt"]).drop("salt"))
    return pairs


def _need(percent: int, xl: Column, xh: Column, yl: Column, yh: Column) -> Column:
    """The least number of common prefix tokens of sets with sizes in these ranges (at least 1)."""
    px = lambda n: n - F.ceil(F.lit(percent) * n / 100 - 1e-9) + 1
    one = px(xh) - xh + _overlap(xh, yl, percent)
    two = px(yh) - yh + _overlap(xl, yh, percent)
    return F.greatest(F.least(one, two) - 1, F.lit(1))


def _filtered(pairs: DataFrame, small: DataFrame, percent: int, heads: DataFrame | None = None) -> DataFrame:
    """Pairs of sets whose sizes and prefixes allow a link; prefixes are a tenth or a fifth of a set. Pairs with one of heads pass."""
    pairs = _meet(stage(pairs, "pairs"), small, ["n", "prefix"])
    xn, yn = F.col("x_n"), F.col("y_n")
    common = F.size(F.array_intersect("x_prefix", "y_prefix"))
    fits = (100 * F.least(xn, yn) >= percent * F.greatest(xn, yn)) & (common >= _need(percent, xn, xn, yn, yn))
    pairs = pairs.select("x", "y", fits.alias("fits"))
    if heads is not None:
        for c in "xy":
            pairs = pairs.join(heads.withColumnsRenamed({"h": c, "is_head": f"{c}_head"}), c, "left")
        pairs = pairs.withColumn("fits", F.col("fits") | F.coalesce("x_head", "y_head", F.lit(False)))
    return pairs.where("fits").select("x", "y")


def _verified(src: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs with the exact size of their difference and whether they link. Only sets in pairs are computed."""
    pairs = stage(pairs, "candidates")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "tokens": [shingle_set(t, k) for t in b["body"]]})

    asked = stage(pairs.select(F.col("x").alias("id")).unionAll(pairs.select(F.col("y").alias("id"))).distinct(), "asked")
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)  # texts then stay where they are
    texts = src.join(asked, F.col("doc") == F.col("id"), "left_semi")
    sets = texts.mapInPandas(full, "doc long, tokens array<long>")
    sets = stage(sets, "sets")
    pairs = _meet(pairs, sets, ["tokens"])
    both = F.size(F.array_intersect("x_tokens", "y_tokens")).cast("long")
    total = F.size("x_tokens") + F.size("y_tokens")
    pairs = pairs.select("x", "y", both.alias("both"), total.cast("long").alias("total"))
    linked = 100 * F.col("both") >= percent * (F.col("total") - F.col("both"))
    # rows that repeat an id give a pair several times
    return pairs.groupBy("x", "y").agg(F.min(F.col("total") - 2 * F.col("both")).alias("apart"), F.max(linked).alias("linked"))
