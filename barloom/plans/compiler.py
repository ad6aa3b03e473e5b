"""Compiles expressions to one Spark plan.

All expressions of a call share their subexpressions: each distinct window function is one column. Windows are levelled by
depth, one select a level, and all time windows share partitioning and order, so that any number of
expressions costs one exchange and one sort by symbol and date. Windows of more than rolling.LONG rows are put together from running states
instead of being walked for every row; they add sorts within the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling, series
from barloom.plans.expressions import LAGS, PAIRED, ROLLING, Node, parse

SCOPES = {"symbol": "symbol", "date": "trade_date"}


class Compiler:
    def __init__(self, scope: str = "symbol"):
        if scope not in SCOPES:
            raise ValueError(f"scope must be one of {sorted(SCOPES)}")
        self.scope = SCOPES[scope]
        self.names: dict[Node, str] = {}

    def column(self, node: Node) -> Column:
        """The column of a node whose windows are all there already."""
        return F.col(self.names[node]) if node in self.names else self.build(node)

    def number(self, node: Node) -> Column:
        c = self.column(node)
        return c.cast("double") if node.is_bool else c

    def truth(self, node: Node) -> Column:
        """A number counts as true unless it is zero; a missing one is true."""
        return self.column(node) if node.is_bool else F.coalesce(self.column(node) != 0, F.lit(True))

    def build(self, node: Node) -> Column:
        if node.kind == "field":
            return F.col(node.name)
        if node.kind == "const":
            return F.lit(node.value)
        if node.kind == "neg":
            return -self.number(node.args[0])
        if node.kind == "cmp":
            return series.COMPARE[node.name](self.number(node.args[0]), self.number(node.args[1]))
        if node.kind == "bool":
            a, b = (self.truth(x) for x in node.args)
            return a & b if node.name == "and" else a | b
        if node.kind == "op":
            a, b = (self.number(x) for x in node.args)
            return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": lambda v: series.ratio(a, v), "**": lambda v: series.power(a, v)}[node.name](b)
        return self.call(node)

    def call(self, node: Node) -> Column:
        name = node.name
        if name == "where":
            a, b = (self.column(x) if node.is_bool else self.number(x) for x in node.args[1:])
            return F.when(self.truth(node.args[0]), a).otherwise(b)
        args = [self.number(x) for x in node.args]
        if name in ("rank", "zscore"):
            return getattr(series, name)(*args, self.scope)
        if name == "winsorize":
            return series.winsorize(*args, node.value, self.scope)
        if node.is_window:
            return getattr(series, name)(*args, node.n)
        simple = {
            "abs": F.abs, "sign": F.signum, "log1p": series.log1p, "sqrt": series.sqrt, "clip": series.clip, "min": series.least, "max": series.greatest,
            "div": series.ratio, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
        }
        return simple[name](*args)


def with_expressions(panel: DataFrame, expressions: dict[str, str | Node], scope: str = "symbol") -> DataFrame:
    """The panel with one double column for each named expression."""
    trees = {name: parse(e) if isinstance(e, str) else e for name, e in expressions.items()}
    fields = {x.name for t in trees.values() for x in t.walk() if x.kind == "field"}
    if missing := sorted(fields - set(panel.columns)):
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    c = Compiler(scope)
    out = with_windows(panel, [x for t in trees.values() for x in t.walk() if is_computed(x)], c)
    return out.select(*panel.columns, *[c.number(t).cast("double").alias(name) for name, t in trees.items()])


def is_computed(x: Node) -> bool:
    """Whether a node is a window function that takes a column of its own."""
    return x.is_window and not (x.name == "delay" and x.n == 0)


def with_windows(panel: DataFrame, nodes: list[Node], c: Compiler) -> DataFrame:
    """The panel with a column for each distinct window function of nodes (which hold those within them as well); c knows the columns' names afterwards."""
    wanted = dict.fromkeys(nodes)
    out = panel
    for level in sorted({x.depth for x in wanted}):
        here = {x: f"__w{len(c.names) + i}" for i, x in enumerate(w for w in wanted if w.depth == level)}
        long = {x for x in here if x.name in ROLLING | PAIRED and x.n > rolling.LONG}
        if short := {name: c.build(x) for x, name in here.items() if x not in long}:
            out = out.withColumns(short)
        for n in sorted({x.n for x in long if x.name != "ts_rank"}):
            out = rolling.rolling(out, {here[x]: (x.name, [c.number(a) for a in x.args]) for x in here if x in long and x.name != "ts_rank" and x.n == n}, n)
        if ranks := {here[x]: (c.number(x.args[0]), x.n) for x in here if x in long and x.name == "ts_rank"}:
            out = rolling.rolling_rank(out, ranks)
        c.names.update(here)
    return out


def evaluate(panel: DataFrame, expression: str, scope: str = "symbol", direction: int = 1, on_error: str = "raise") -> DataFrame:
    """symbol, trade_date, factor_value of one expression; rows without a symbol are left out.

    on_error="null": an expression that cannot be compiled gives NULL values instead of an error.
    """
    rows = panel.where("symbol is not null")
    try:
        out = with_expressions(rows, {"factor_value": expression}, scope)
    except ValueError:
        if on_error != "null":
            raise
        out = rows.withColumn("factor_value", F.lit(None).cast("double"))
    value = F.col("factor_value") if direction == 1 else F.col("factor_value") * F.lit(float(direction))
    return out.select("symbol", "trade_date", value.alias("factor_value"))


def evaluate_all(
    panel: DataFrame, factors: dict[str, tuple[str, int]], scope: str = "symbol", keep: tuple[str, ...] = (), through: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Long form of many expressions in one pass: factor_id, symbol, trade_date, keep, factor_value (times direction).

    through: what the values in wide form, a row for each symbol and date, pass through before they become long: shared.written, where the long form is read several times.
    """
    wide = with_expressions(panel.where("symbol is not null"), {f"__f{i}": e for i, (e, _) in enumerate(factors.values())}, scope)
    if through:
        wide = through(wide.select("symbol", "trade_date", *keep, *[f"__f{i}" for i in range(len(factors))]))
    values = [
        F.struct(F.lit(name).alias("factor_id"), (F.col(f"__f{i}") * F.lit(float(d)) if d != 1 else F.col(f"__f{i}")).alias("factor_value"))
        for i, (name, (_, d)) in enumerate(factors.items())
    ]
    return wide.select("symbol", "trade_date", *keep, F.inline(F.array(*values))).select("factor_id", "symbol", "trade_date", *keep, "factor_value")
