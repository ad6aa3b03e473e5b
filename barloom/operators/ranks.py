"""Exact ranks within groups of any size, such as all symbols of one date.

A window ranks a group in one task. Groups of up to ROWS rows are ranked that way; larger ones are cut at values that lie about ROWS rows apart, and each range
between two cuts is a window of its own: a row's rank there and the numbers of rows in the ranges before it give its rank in the group. A cut is a range of one value,
whose rows need no window, as the number of its rows tells their average place; so neither a large group nor a large tie is one task's alone.
Cuts come from random rows, which decide how even the ranges are and never what the ranks are.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import average_rank, guarded_corr
from barloom.shared import written

#: Rows of the largest group that one window ranks, and of a range of a larger one, about.
ROWS = 1 << 20
#: Random rows that tell where a range ends.
DRAWN = 64


def _same(names: list[str], mark: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in names])


def _marked(df: DataFrame, names: list[str], *others: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__s_{c}") for c in names], *others)


def _large(df: DataFrame, group: list[str], value: str, parts: int | None) -> tuple[DataFrame, float] | None:
    """The groups of more rows than one window takes, with __all, the number of their values, and the rows of a range; None if there are none."""
    sizes = written(df.groupBy(*group).agg(F.count(value).alias("__all")), "sizes")
    rows = ROWS if parts is None else max(1.0, (sizes.agg(F.sum("__all")).first()[0] or 0) / parts)
    large = sizes.where(F.col("__all") > rows)
    return None if large.isEmpty() else (large, rows)


def _cuts(base: DataFrame, group: list[str], value: str, large: DataFrame, rows: float) -> DataFrame:
    """__s_ group, __all, __cuts: ascending values of each large group that lie about so many rows apart."""
    share = F.col("__all") / (F.ceil(F.col("__all") / rows) * DRAWN)  # one row of so many is drawn
    held = base.where(F.col(value).isNotNull()).select(*group, (F.col(value) + F.lit(0.0)).alias("__v"))
    drawn = held.join(F.broadcast(_marked(large, group, "__all")), _same(group, "__s_")).where(F.rand(7) * share < 1)
    of = drawn.groupBy(*[f"__s_{c}" for c in group], "__all").agg(F.array_sort(F.collect_list("__v")).alias("__v"))
    every = F.filter("__v", lambda v, i: i % DRAWN == DRAWN - 1)
    return written(of.select(*[f"__s_{c}" for c in group], "__all", F.array_distinct(every).alias("__cuts")), "cuts")


def _ranked(df: DataFrame, base: DataFrame, group: list[str], value: str, name: str, cuts: DataFrame | None, count: str | None) -> DataFrame:
    """df with name and count; base: where the values of df's rows are counted."""
    if cuts is None:
        total = {count: F.count(value).over(Window.partitionBy(*group))} if count else {}
        return df.withColumns({name: average_rank(F.col(value), *group), **total})

    def dealt(rows: DataFrame) -> DataFrame:
        """Ranges of a large group are numbered evenly, its cuts oddly; -1 holds its rows without a value."""
        v = F.col(value) + F.lit(0.0)
        at = F.size(F.filter("__cuts", lambda c: c < v)) * 2 + F.array_contains("__cuts", v).cast("int")
        return rows.join(F.broadcast(cuts), _same(group, "__s_"), "left").withColumn("__range", F.when(F.col("__cuts").isNull(), 0).when(v.isNull(), -1).otherwise(at))

    w = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each range of a large group
    spans = dealt(base.select(*group, value)).where("__cuts is not null and __range >= 0").groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    spans = spans.withColumn("__before", F.sum("__n").over(w) - F.col("__n"))
    spans = F.broadcast(spans.select(*[F.col(c).alias(f"__r_{c}") for c in (*group, "__range")], "__n", "__before"))
    rows = dealt(df).drop(*[f"__s_{c}" for c in group], "__cuts")
    here = _same([*group, "__range"], "__r_")
    inside = rows.where("__range >= 0 and __range % 2 = 0")
    local = {"__rank": average_rank(F.col(value), *group, "__range"), "__size": F.count(value).over(Window.partitionBy(*group, "__range"))}
    inside = inside.withColumns(local).join(spans, here, "left").withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
    cut = rows.where("__range < 0 or __range % 2 = 1").join(spans, here, "left").withColumns({"__rank": F.col("__before") + (F.col("__n") + 1) / F.lit(2.0), "__size": F.lit(0).cast("long")})
    total = [F.coalesce("__all", "__size").alias(count)] if count else []
    return inside.unionByName(cut).select(*df.columns, F.col("__rank").alias(name), *total)


def with_average_rank(df: DataFrame, group: list[str], value: str, name: str, parts: int | None = None, count: str | None = None) -> DataFrame:
    """df with name, the rank of value (double) from 1 within group, ties at their average place and null for null values, and with count, the
    number of non-null values of the group. Null group keys are keys as any other. NaN ranks last.

    df is read twice; if some group is large, it is written first. parts: number of ranges in all, about (default: ranges of ROWS rows).
    """
    found = _large(df, group, value, parts)
    if found is None:
        return _ranked(df, df, group, value, name, None, count)
    base = written(df, "base")
    return _ranked(base, base, group, value, name, _cuts(base, group, value, *found), count)


def rank_by_range(df: DataFrame, group: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with name, the share of the group's values up to the row's own: as rank() of the expression language, for groups of any size."""
    ranked = with_average_rank(df, group, value, "__rank", parts, "__count")
    return ranked.select(*df.columns, (F.col("__rank") / F.nullif(F.col("__count"), F.lit(0))).alias(name))


def daily_rankic(values: DataFrame, least: int = 5, parts: int | None = None) -> DataFrame:
    """factor_id, trade_date, rankic, n: as metrics.daily_ic on values as they are, for dates of any number of symbols. Values are read twice."""
    group = ["factor_id", "trade_date"]
    pairs = values.where("factor_value is not null and forward_return is not null").select(*group, "factor_value", "forward_return")
    found = _large(pairs, group, "factor_value", parts)
    base = pairs if found is None else written(pairs, "base")
    ranked = base
    for value, name, count in (("factor_value", "__x", "__n_all"), ("forward_return", "__y", None)):
        ranked = _ranked(ranked, base, group, value, name, found and _cuts(base, group, value, *found), count)
    # ranks less their mean: where all are equal they are zeros, whose spread stays zero however tasks' sums are merged
    apart = [F.col(c) - (F.col("__n_all") + 1) / F.lit(2.0) for c in ("__x", "__y")]
    corr = guarded_corr(*apart, lambda c: c)
    return ranked.groupBy(*group).agg(corr.alias("rankic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
