"""Expressions on new rows, from the stored tail of each symbol's history instead of the history itself.

A value depends on as many earlier rows of its symbol as its expression looks back to (plans.slices.look_back). The last rows of each symbol are
therefore all the state that is needed: to evaluate a later period with warm-up, or to add days to values that are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.plans.compiler import with_expressions
from barloom.plans.expressions import Node, parse
from barloom.plans.slices import reach, with_slices
from barloom.sources.committed import ResultSet


class LateRowsError(ValueError):
    """Rows that do not lie after the state's rows of their symbol."""


def tail(panel: DataFrame, n: int) -> DataFrame:
    """The last n dated rows of each symbol. Spark keeps n rows of a symbol in each task before it shuffles."""
    latest = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    return panel.where("trade_date is not null").withColumn("__nth", F.row_number().over(latest)).where(F.col("__nth") <= n).drop("__nth")


def late_symbols(state: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols with a new row that has no date or one not after the symbol's last date in the state. Both sides are aggregated before they meet."""
    first = new.groupBy("symbol").agg(F.min("trade_date").alias("first"), F.count_if(F.col("trade_date").isNull()).alias("undated"))
    last = state.groupBy(F.col("symbol").alias("__of")).agg(F.max("trade_date").alias("last"))
    met = first.join(last, F.col("symbol").eqNullSafe(F.col("__of")), "left")
    return met.where((F.col("undated") > 0) | (F.col("first") <= F.col("last"))).select("symbol", "first", "last")


def with_warm_up(state: DataFrame, new: DataFrame, expressions: dict[str, str | Node], slices: int | None = None) -> DataFrame:
    """The rows of new with one column for each expression, computed as if the state's rows came before them. Columns that the state lacks are NULL there.
    Expressions of a symbol's whole history are refused (ValueError). slices: evaluate in so many slices (plans.slices), for hot symbols."""
    trees = {k: parse(e) if isinstance(e, str) else e for k, e in expressions.items()}
    back = reach(trees)
    before = state.select(*[c for c in new.columns if c in state.columns]).withColumn("__new", F.lit(False))
    rows = tail(before, back).unionByName(new.withColumn("__new", F.lit(True)), allowMissingColumns=True) if back else new.withColumn("__new", F.lit(True))
    out = with_slices(rows, trees, slices) if slices else with_expressions(rows, trees)
    return out.where("__new").select(*new.columns, *trees)


class KeptValues:
    """Values of expressions kept in a result set, one version for each batch of dates.

    Each version holds the batch's values and the state for the next batch, committed together: a run that dies between them leaves the last
    version, and may be repeated. A batch that is offered twice, or that has rows before the state's, is refused (LateRowsError).
    """

    def __init__(self, spark: SparkSession, root: str, expressions: dict[str, str]):
        self.results, self.expressions = ResultSet(spark, root), dict(expressions)
        self.trees = {k: parse(e) for k, e in expressions.items()}
        self.back = reach(self.trees)
        self.fields = sorted({x.name for t in self.trees.values() for x in t.walk() if x.kind == "field"})

    def _last(self) -> int:
        """The last version, which must be of the same expressions; 0 if there is none."""
        have = self.results.versions()
        if have and self.results.manifest()["facts"].get("expressions") != self.expressions:
            raise ValueError(f"{self.results.root} keeps other expressions")
        return have[-1] if have else 0

    def append(self, new: DataFrame, slices: int | None = None) -> int:
        """Evaluates the batch's rows from the state and commits them; returns the version. The batch is read three times. Rows without a symbol have
        no place in a history and are left out, as evaluate() does."""
        new = new.where("symbol is not null").select("symbol", "trade_date", *self.fields)
        last = self._last()
        state = self.results.table("state", last) if last else new.limit(0)
        if late := late_symbols(state, new).limit(5).collect():
            raise LateRowsError("; ".join(f"{r['symbol']}: from {r['first']}, known to {r['last']}" for r in late))
        values = with_warm_up(state, new, self.trees, slices).select("symbol", "trade_date", *self.trees)
        # at least one row of each symbol stays, as the last date that is known
        left = tail(state.unionByName(new), max(self.back, 1))
        return self.results.commit({"values": values, "state": left}, {"expressions": self.expressions, "look_back": self.back}, after=last)

    def values(self) -> DataFrame:
        """symbol, trade_date and the expressions, over all batches."""
        return self.results.history("values")
