"""Mixing sources to target weights by entropy balancing.

Every document i of source s gets a rate r_i, the number of times the mix should take it. Among all
rates between 0 and `cap` that meet the token constraint of each source,

    sum over the documents of s of  r_i * size_i  =  target_s,

the solver takes those closest to 1 in relative entropy (the entropy with both bounds, so that no rate
leaves [0, cap]). The optimum is an exponential tilt in the document's tokens with one dual variable
per source:

    r_i = cap * e / (e + cap - 1),   e = exp(lambda_s * size_i / mean_size_s)

The dual is convex and splits by source. Newton's method runs on all sources at once: an iteration is one
aggregation (gradient and curvature of each source) over the cells (source, size, number of documents),
which are far fewer than documents, and one update of the table of dual variables. A step that leaves the
bracket kept for each source is replaced by its midpoint. The table never passes through the driver; only
the largest relative error does.

Rates depend on source and size alone, so rounding works on cells: walking a source's cells by size, the
running sum of rates is rounded, which leaves an error of less than one document of the largest size for
a whole source. A ladder of cells (one in each quarter octave of sizes, at most about 100 a source) then takes
or gives single copies, largest first, until a few words are left of that error. A cell's copies are then dealt to its salted parts (at most `PARTS`) and inside a
part by hashed order. No window ever holds a whole source or a whole cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage, word_count

#: A cell (source, size) is dealt over so many parts at most, each of about PART_ROWS documents.
PARTS, PART_ROWS = 1024, 128
#: Newton iterations stop at this relative error of the worst source, or after MAX_STEPS.
TOLERANCE, MAX_STEPS = 1e-9, 80

KEY = ["__null", "__src"]


def source_targets(cells: DataFrame, cap: float, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets by source from cells (__null, __src, __size, __n).

    Sources by code point, null last, get the weights in turn. They share the total size; a target stops
    at cap times the source's size and the excess is shared again by weight. The fixed point is
    min(cap * size_s, theta * weight_s) with one theta, found by ordering sources by cap * size / weight.
    """
    by_source = cells.groupBy(*KEY).agg(
        F.sum(F.col("__size") * F.col("__n")).alias("__total"), F.sum("__n").alias("__docs")
    )
    order = Window.orderBy("__null", "__src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    t = by_source.withColumn("__w", weight).withColumn("__cap", F.col("__total") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__null", "__src")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("__used", F.coalesce(F.sum("__cap").over(before), F.lit(0.0))).withColumn(
        "__left", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    )
    # theta if exactly the sources before this one are full; the true one is the first that fits
    t = t.withColumn("__theta", (F.sum("__total").over(everything) - F.col("__used")) / F.col("__left"))
    fits = F.when(F.col("__theta") * F.col("__w") <= F.col("__cap"), F.col("__theta"))
    theta = F.coalesce(F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return t.select(
        *KEY, "__total", "__docs", F.when(theta * F.col("__w") < F.col("__cap"), theta * F.col("__w")).otherwise(F.col("__cap")).alias("__target")
    )


def _rate(cap: float) -> Column:
    """The rate of a cell under its source's dual variable; the exponent is kept in range."""
    x = F.col("__lambda") * F.col("__size") / F.col("__mean")
    e = F.exp(F.greatest(F.least(-x, F.lit(700.0)), F.lit(-700.0)))
    return F.lit(float(cap)) / (1 + F.lit(float(cap - 1)) * e)


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """The dual variable of every source: columns KEY, __state (0 solved, 1 full, -1 empty), __lambda, __mean."""
    state = F.when(F.col("__target") <= 0, -1).when(F.col("__target") >= F.col("__total") * cap * (1 - 1e-12), 1).otherwise(0)
    dual = targets.select(
        *KEY,
        "__target",
        state.alias("__state"),
        F.greatest(F.col("__total") / F.col("__docs"), F.lit(1e-9)).alias("__mean"),
        F.lit(0.0).alias("__lambda"),
        F.lit(-1e7).alias("__lo"),
        F.lit(1e7).alias("__hi"),
        F.lit(1.0).alias("__error"),
    )
    dual = stage(dual, "dual")
    for _ in range(MAX_STEPS):
        rate = _rate(cap)
        tokens = F.col("__size") * F.col("__n")
        sums = (
            cells.join(dual.where("__state = 0"), KEY)
            .groupBy(*KEY)
            .agg(
                F.sum(tokens * rate).alias("__got"),
                F.sum(tokens * F.col("__size") / F.col("__mean") * rate * (1 - rate / cap)).alias("__slope"),
            )
        )
        gap = F.col("__got") - F.col("__target")
        lo, hi = F.when(gap < 0, F.col("__lambda")).otherwise(F.col("__lo")), F.when(gap > 0, F.col("__lambda")).otherwise(F.col("__hi"))
        most = 1 + F.abs("__lambda")
        step = F.greatest(F.least(F.when(F.col("__slope") > 0, -gap / F.col("__slope")).otherwise(-F.signum(gap) * most), most), -most)
        there = F.col("__lambda") + step
        inside = F.when((there > lo) & (there < hi), there).otherwise((lo + hi) / 2)
        error = F.abs(gap) / F.col("__target")
        found = F.col("__got").isNull() | (error <= TOLERANCE)
        keep = lambda new, old: F.when(found, F.col(old)).otherwise(new).alias(old)
        dual = stage(
            dual.join(sums, KEY, "left").select(
                *KEY, "__target", "__state", "__mean", keep(inside, "__lambda"), keep(lo, "__lo"), keep(hi, "__hi"),
                F.coalesce(error, F.lit(0.0)).alias("__error"),
            ),
            "dual",
        )
        if (dual.agg(F.max("__error")).first()[0] or 0.0) <= TOLERANCE:
            break
    return dual


def _settle(cells: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Moves single copies between the cells of a ladder of sizes until each source's rest is a few words."""
    cell = F.struct(
        F.col("__size").alias("size"), F.col("__copies").alias("down"), (F.col("__n") * cap - F.col("__copies")).alias("up")
    )
    rungs = (
        cells.where("__size > 0")
        .groupBy(*KEY, F.floor(4 * F.log2("__size")).alias("__rung"))
        .agg(F.max_by(cell, "__n").alias("__cell"), F.sum(F.col("__copies") * F.col("__size")).alias("__got"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("__cell"), asc=False).alias("__cells"), F.sum("__got").alias("__got"))
        .join(targets.select(*KEY, "__target"), KEY)
    )
    zero = F.struct((F.col("__target") - F.col("__got")).alias("rest"), F.array().cast("array<struct<size:bigint,by:bigint>>").alias("moves"))

    def move(acc: Column, c: Column) -> Column:
        by = F.greatest(F.least(F.round(acc["rest"] / c["size"]).cast("long"), c["up"]), -c["down"])
        moved = F.concat(acc["moves"], F.array(F.struct(c["size"].alias("size"), by.alias("by"))))
        return F.struct((acc["rest"] - by * c["size"]).alias("rest"), F.when(by != 0, moved).otherwise(acc["moves"]).alias("moves"))

    moves = rungs.select(*KEY, F.inline(F.aggregate("__cells", zero, move)["moves"])).withColumnsRenamed({"size": "__size", "by": "__by"})
    return cells.join(moves, [*KEY, "__size"], "left").withColumn("__copies", F.col("__copies") + F.coalesce("__by", F.lit(0))).drop("__by")


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    cap: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
) -> DataFrame:
    """One row per row of docs: doc_id, source, __size, source_size, target, rate, copies.

    size defaults to the number of words of column text (null: 0). Null sources form one source, the last.
    A document of size 0 takes part with copies 1 where its source has no size at all or keeps its rate;
    it never changes a total. Ties and repeated rows are separate rows with one rate. An empty table gives
    an empty result. The result depends on the rows only, so reruns agree.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = stage(
        docs.select(
            F.col(doc_id).alias("__id"),
            F.col(source).isNull().alias("__null"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__src"),
            size.cast("long").alias("__size"),
        ),
        "sizes",
    )
    cells = stage(rows.groupBy(*KEY, "__size").agg(F.count(F.lit(1)).alias("__n")), "cells")
    targets = stage(source_targets(cells, cap, weights), "targets")
    dual = solve_dual(cells, targets, cap)

    solved = cells.join(dual.select(*KEY, "__state", "__mean", "__lambda"), KEY)
    rate = F.when(F.col("__state") == 1, F.lit(float(cap))).when(F.col("__state") == -1, F.lit(0.0)).otherwise(_rate(cap))
    run = Window.partitionBy(*KEY).orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.round(F.sum(F.col("__n") * F.col("__rate")).over(run), 6) + 0.5)
    solved = solved.withColumn("__rate", rate).withColumn("__upto", upto)
    by_size = Window.partitionBy(*KEY).orderBy("__size")
    copies = F.col("__upto") - F.coalesce(F.lag("__upto").over(by_size), F.lit(0))
    solved = stage(solved.withColumn("__copies", F.least(copies, F.col("__n") * cap)).drop("__upto"), "rounded")
    solved = _settle(solved, targets, cap).withColumn("__parts", F.least(F.lit(PARTS), F.ceil(F.col("__n") / PART_ROWS)).cast("long"))
    solved = stage(solved.join(targets.select(*KEY, "__total", "__target"), KEY), "rates")

    # every document knows its part; a part's copies follow from the running share of the cell's copies
    place = F.xxhash64(F.col("__id"), F.lit(17))
    cell = [*KEY, "__size"]
    placed = rows.withColumn("__spot", F.pmod(place, F.lit(PARTS)))
    spots = placed.groupBy(*cell, "__spot").agg(F.count(F.lit(1)).alias("__m"))
    # a part is a range of spots: a cell with few documents has one part, a large one up to PARTS
    part = F.floor(F.col("__spot") * F.col("__parts") / PARTS)
    parts = spots.join(solved, cell).withColumn("__part", part).groupBy(*cell, "__part").agg(
        F.sum("__m").alias("__m"),
        *[F.first(c).alias(c) for c in ("__n", "__parts", "__copies", "__rate", "__total", "__target")],
    )
    so_far = F.sum("__m").over(Window.partitionBy(*cell).orderBy("__part"))
    share = lambda upto: F.expr(f"__copies * ({upto}) div __n")
    parts = stage(
        parts.withColumn("__end", so_far)
        .withColumn("__take", share("__end") - share("__end - __m"))
        .select(*cell, "__part", "__parts", "__m", "__take", "__rate", "__total", "__target"),
        "parts",
    )
    known = placed.join(solved.select(*cell, "__parts"), cell).withColumn("__part", part).drop("__parts")
    out = known.join(parts, [*cell, "__part"])
    nth = F.row_number().over(Window.partitionBy(*cell, "__part").orderBy(place, "__id"))
    return out.withColumn("__nth", nth).select(
        F.col("__id").alias(doc_id),
        F.when(~F.col("__null"), F.col("__src")).alias(source),
        "__size",
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__rate").alias("rate"),
        (F.expr("__take div __m") + (F.col("__nth") <= F.col("__take") % F.col("__m")).cast("long")).alias("copies"),
    )
