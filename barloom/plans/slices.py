"""Expressions over slices of a symbol's history.

By default all rows of a symbol are one task. An expression without whole-series functions looks back a number of rows that its tree tells, so
its rows can be dealt to slices of a symbol, each with copies of the last rows before it. Slices are range partitions of (symbol, date), which
are of about equal size whatever the symbols: small symbols share one, a hot one spans many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import series
from barloom.plans.compiler import Compiler, is_computed, with_expressions, with_windows
from barloom.plans.expressions import LAGS, PAIRED, ROLLING, WHOLE, Node, parse
from barloom.shared import checkpointed

#: Rows of the table of which part serves which slice that are broadcast (counted first; about 50 bytes each), and joined by shuffle beyond.
BROADCAST_PARTS = 500_000


def look_back(node: Node) -> int | None:
    """How many rows before its own a value depends on; None for functions of the whole series."""
    if node.kind == "call" and node.name in WHOLE:
        return None
    below = [look_back(a) for a in node.args]
    if None in below:
        return None
    own = node.n if node.name in LAGS else node.n - 1 if node.name in ROLLING | PAIRED else 0
    return max(below, default=0) + (own if node.kind == "call" else 0)


def sliceable(expressions: dict[str, str | Node]) -> bool:
    return all(look_back(parse(e) if isinstance(e, str) else e) is not None for e in expressions.values())


def _per_part(panel: DataFrame, expressions: dict[str, str | Node]) -> DataFrame:
    """Expressions with (symbol, __slice) in the place of the symbol; the rows with __own."""
    names = [c for c in panel.columns if c not in ("__slice", "__own")]
    rows = panel.withColumn("symbol", F.struct(F.col("symbol").alias("of"), F.col("__slice").alias("slice")))
    out = with_expressions(rows, expressions).where("__own").withColumn("symbol", F.col("symbol.of"))
    return out.select(*names, *expressions)


def sliced(panel: DataFrame, back: int, n: int) -> DataFrame:
    """The panel's rows with __slice and __own, in n slices of about equal size; rows with __own false are copies, the `back` rows of the symbol before
    each slice. The sorted panel is checkpointed, as a slice is what a partition of it holds."""
    dealt = panel.repartitionByRange(n, F.col("symbol").asc_nulls_first(), F.col("trade_date").asc_nulls_first()).sortWithinPartitions(F.col("symbol").asc_nulls_first(), F.col("trade_date").asc_nulls_first())
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = checkpointed(dealt.withColumns({"__slice": F.shiftright(F.monotonically_increasing_id(), 33).cast("long"), "__place": place}))
    # a row for each symbol and slice; of symbols in several slices: where each part stands among the symbol's rows
    parts = dealt.groupBy("symbol", "__slice").agg(F.min("__place").alias("from_place"), F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("symbol")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    parts = parts.join(several.withColumnRenamed("symbol", "of"), same("symbol", "of"), "left_semi")
    order = Window.partitionBy("symbol").orderBy("__slice")
    parts = parts.withColumn("starts", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    # a part serves the later ones that begin within reach of its end
    one = parts.select(F.col("symbol").alias("of"), F.col("__slice").alias("in_slice"), "from_place", F.col("n").alias("size"), "starts")
    two = parts.select(F.col("symbol").alias("of_two"), F.col("__slice").alias("to_slice"), F.col("starts").alias("to_starts"))
    served = one.join(two, same("of", "of_two") & (F.col("to_slice") > F.col("in_slice")) & (F.col("to_starts") - F.col("starts") - F.col("size") < back))
    served = served.select("of", "in_slice", "to_slice", (F.col("from_place") - F.col("starts") + F.col("to_starts") - back).alias("from_here"))
    served = checkpointed(served)
    halo = dealt.join(F.broadcast(served) if served.count() <= BROADCAST_PARTS else served, same("symbol", "of") & (F.col("__slice") == F.col("in_slice")) & (F.col("__place") >= F.col("from_here")))
    halo = halo.select(*panel.columns, F.col("to_slice").alias("__slice"), F.lit(False).alias("__own"))
    own = dealt.select(*panel.columns, "__slice", F.lit(True).alias("__own"))
    return own.unionByName(halo)


def with_slices(panel: DataFrame, expressions: dict[str, str | Node], slices: int | None = None) -> DataFrame:
    """As with_expressions(panel, expressions, "symbol"), for expressions of a bounded look-back only (ValueError for others), by slices.

    Rows of a symbol are ordered by trade_date, null dates first; rows with a null symbol are a symbol of their own. slices: their number
    (default: spark.sql.shuffle.partitions).
    """
    trees = {k: parse(e) if isinstance(e, str) else e for k, e in expressions.items()}
    return _per_part(sliced(panel, reach(trees), slices or int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))), trees)


def reach(trees: dict[str, Node]) -> int:
    """The furthest look-back of the expressions."""
    backs = [look_back(t) for t in trees.values()]
    if None in backs:
        raise ValueError("functions of a symbol's whole history have no bounded look-back")
    return max(backs, default=0)


def up_to_dates(panel: DataFrame, expressions: dict[str, str | Node], dates: list) -> DataFrame:
    """Values at each of dates (a short list) computed from rows up to that date alone: symbol, trade_date, expressions, for symbols with a row on the date.
    Functions of the whole series have symbol scope. Keys are taken as unique.

    Every date's rows within reach (all up to it, if some function reads the whole series) are copied once, all in one exchange. Only the value at the
    last row of a copied history is asked for, so only windows within windows are computed row by row; the outer ones are aggregates of the rows they reach.
    """
    trees = {k: parse(e) if isinstance(e, str) else e for k, e in expressions.items()}
    back = reach(trees) if sliceable(trees) else None
    fields = sorted({x.name for t in trees.values() for x in t.walk() if x.kind == "field"})
    w = Window.partitionBy("symbol").orderBy("trade_date")
    # rows of the symbol up to each date; 0 where it has none on the date itself
    up_to = lambda d: F.when(F.bool_or(F.col("trade_date") == F.lit(d)).over(w_all), F.count_if(F.col("trade_date") <= F.lit(d)).over(w_all)).otherwise(0)
    w_all = Window.partitionBy("symbol")
    placed = panel.where("trade_date is not null").select("symbol", "trade_date", *fields)
    placed = placed.withColumns({"__place": F.row_number().over(w), **{f"__last{i}": up_to(d) for i, d in enumerate(dates)}})
    tags = F.array(*[F.struct(F.lit(d).alias("__slice"), (F.col(f"__last{i}") - F.col("__place")).alias("__back")) for i, d in enumerate(dates)])
    near = F.filter(tags, lambda t: (t["__back"] >= 0) & (F.lit(True) if back is None else t["__back"] <= back))
    copies = placed.select("symbol", "trade_date", *fields, F.inline(near))
    rows = copies.select(F.struct(F.col("symbol").alias("of"), F.col("__slice").alias("slice")).alias("symbol"), "trade_date", *fields, "__back")
    ends = at_last_rows(rows, trees)
    return ends.select(F.col("symbol.of").alias("symbol"), F.col("symbol.slice").alias("trade_date"), *trees)


def at_last_rows(rows: DataFrame, trees: dict[str, Node]) -> DataFrame:
    """symbol and the expressions' values at the symbol's last row. rows hold __back, the number of the symbol's rows after each."""
    outer: dict[Node, str] = {}

    def gather(x: Node) -> None:
        if is_computed(x):
            outer.setdefault(x, f"__o{len(outer)}")
        else:
            for a in x.args:
                gather(a)

    for t in trees.values():
        gather(t)
    c = Compiler()
    out = with_windows(rows, [y for x in outer for a in x.args for y in a.walk() if is_computed(y)], c)
    back, own = F.col("__back"), lambda x: F.max(F.when(F.col("__back") == 0, x))
    ranked = [x for x in outer if x.name in ("rank", "ts_rank")]
    out = out.withColumns({f"{outer[x]}_own": own(c.number(x.args[0])).over(Window.partitionBy("symbol")) for x in ranked})

    def end(x: Node) -> Column:
        args = [c.number(a) for a in x.args]
        v = args[0]
        reached = F.lit(True) if x.name in WHOLE else back < x.n
        within = lambda a: F.when(reached, a)
        if x.name in LAGS:
            before = F.max(F.when(back == x.n, v))
            return {"delay": lambda: before, "delta": lambda: own(v) - before, "ret": lambda: series.ratio(own(v) - before, before)}[x.name]()
        if x.name in ("rank", "ts_rank"):
            mine = F.col(f"{outer[x]}_own")
            below, same = F.count_if(reached & (v < mine)), F.count_if(reached & (v == mine))
            return F.when(own(v).isNotNull(), (below + (same + 1) / F.lit(2.0)) / F.nullif(F.count(within(v)), F.lit(0)))
        if x.name in PAIRED:
            one, two = F.when(args[1].isNotNull(), within(v)), F.when(v.isNotNull(), within(args[1]))
            return series.guarded_corr(one, two, lambda a: a) if x.name == "corr" else F.covar_samp(one, two)
        if x.name in ROLLING:
            return {"ts_mean": F.avg, "ts_sum": F.sum, "ts_std": F.stddev_samp, "ts_min": F.min, "ts_max": F.max}[x.name](within(v))
        mean, sd = F.avg(v), F.stddev_samp(v)
        if x.name == "zscore":
            return series.standard(own(v), mean, sd)
        return series.held(own(v), mean, sd, x.value)

    fields = sorted({x.name for t in trees.values() for x in t.walk() if x.kind == "field"})
    ends = out.groupBy("symbol").agg(*[end(x).alias(name) for x, name in outer.items()], *[own(F.col(f)).alias(f) for f in fields], F.lit(0).alias("__any"))
    c = Compiler()
    c.names = dict(outer)
    return ends.select("symbol", *[c.number(t).cast("double").alias(name) for name, t in trees.items()])
