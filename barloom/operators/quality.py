"""The quality gate: nine checks of a factor in order; the first that fails is reported.

Checks of the text run on the driver. Checks of values run for all factors at once: one aggregation for missing values,
infinities and spread, and for the look-ahead test one run over all rows and one over those within reach of the test dates.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import QualityConfig
from barloom.functions.series import guarded_corr
from barloom.library import Factor
from barloom.plans.compiler import with_expressions
from barloom.plans.expressions import FORBIDDEN, ExpressionError, complexity, looks_at_whole_series, parse, windows
from barloom.plans.slices import look_back, up_to_dates
from barloom.shared import written

# Expressions that the gate must reject.
BAD_FACTORS = {
    "bad_negative_shift": "sub(close, shift(close, -1))",
    "bad_future_global_mean": "sub(close, ts_mean(close, 999999))",
    "bad_full_sample_normalization": "div(sub(close, ts_mean(close, 99999)), ts_std(close, 99999))",
    "bad_last_row_reference": "sub(close, delay(close, -1))",
}
LEAST_DATES = 30


@dataclass
class QualityResult:
    factor_id: str
    passed: bool = True
    stage: str = ""
    error: str = ""
    warnings: list[str] = field(default_factory=list)
    valid_ratio: float = 0.0
    is_constant: bool = False
    has_future_info: bool = False
    complexity: int = 0

    def fail(self, stage: str, error: str) -> None:
        if self.passed:
            self.passed, self.stage, self.error = False, stage, error

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def check_text(f: Factor, c: QualityConfig) -> QualityResult:
    r = QualityResult(f.factor_id, complexity=complexity(f.expression or ""))
    if not f.expression or not f.name or f.direction not in (1, -1):
        r.fail("structure", "a factor needs an expression, a name and a direction of 1 or -1")
        return r
    try:
        tree = parse(f.expression)
    except ExpressionError as e:
        r.fail("dsl_whitelist", str(e))
        return r
    if any(n > c.max_window_size for n in windows(tree)):
        r.fail("dsl_whitelist", f"a window exceeds {c.max_window_size}")
    return r


def value_stats(panel: DataFrame, expressions: dict[str, str], scope: str, c: QualityConfig, computed: DataFrame | None = None) -> DataFrame:
    """factor_id, n, valid (share), inf, sd of each factor on all rows (or c.sample_rows first ones by symbol and date), in one aggregation.
    computed: the values on all rows where they are there already, as columns __f0, __f1 and so on."""
    if computed is not None and c.sample_rows is None:
        wide = computed
    else:
        rows = panel if c.sample_rows is None else panel.orderBy("symbol", "trade_date").limit(c.sample_rows)
        wide = with_expressions(rows, {f"__f{i}": e for i, e in enumerate(expressions.values())}, scope)
    stats = []
    for i in range(len(expressions)):
        v = F.col(f"__f{i}")
        stats.append(F.struct(
            F.coalesce(F.avg(v.isNotNull().cast("double")), F.lit(0.0)).alias("valid"),
            F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("inf"),
            F.stddev_samp(F.when(F.abs(v) != float("inf"), v)).alias("sd"),
        ).alias(f"__s{i}"))
    row = wide.agg(F.count(F.lit(1)).alias("n"), *stats)
    named = F.array(*[F.struct(F.lit(f).alias("factor_id"), F.col(f"__s{i}.valid").alias("valid"), F.col(f"__s{i}.inf").alias("inf"), F.col(f"__s{i}.sd").alias("sd")) for i, f in enumerate(expressions)])
    return row.select("n", F.inline(named)).select("factor_id", "n", "valid", "inf", "sd")


def complexity_of(text: Column) -> Column:
    """Characters ( + - * / in a column of expressions, as complexity() counts them."""
    return (F.length(text) - F.length(F.translate(text, "(+-*/", ""))).cast("long")


def truncation_dates(panel: DataFrame, k: int, seed: int | None = 42) -> list[Any]:
    """Up to k test dates after the first LEAST_DATES, drawn without replacement (seed None: at even steps); none for a shorter panel."""
    days = [r[0] for r in panel.select("trade_date").where("trade_date is not null").distinct().orderBy("trade_date").collect()]
    left = len(days) - LEAST_DATES
    if left <= 0:
        return []
    if seed is None:
        return [days[LEAST_DATES + i * left // min(k, left)] for i in range(min(k, left))]
    picked = np.random.default_rng(seed).choice(np.arange(LEAST_DATES, len(days)), size=min(k, left), replace=False)
    return [days[i] for i in sorted(picked)]


def truncation_test(panel: DataFrame, expressions: dict[str, str], dates: list[Any], scope: str = "symbol", computed: DataFrame | None = None) -> DataFrame:
    """factor_id, trade_date, n, max_diff, correlation: values at each date computed on all rows against those computed on
    rows up to that date. Only symbols with both values count, and only dates with two of them.

    The full run is shared by all dates. Expressions with a bounded look-back are computed for all dates in one pass over copies of the rows
    within reach of each; those that read a symbol's whole history, or rank dates, in one over copies of all rows up to each. computed: the full run where it is there
    already, symbol, trade_date and a column for each expression.
    """
    names = {f: f"__f{i}" for i, f in enumerate(expressions)}
    trees = {f: parse(e) for f, e in expressions.items()}
    bounded = {f for f, t in trees.items() if look_back(t) is not None}
    rows = panel.where("symbol is not null")

    def long(df: DataFrame, value: str, some: list[str]) -> DataFrame:
        return df.select("symbol", "trade_date", F.inline(F.array(*[F.struct(F.lit(f).alias("factor_id"), F.col(names[f]).alias(value)) for f in some])))

    def columns(some: list[str]) -> dict[str, Any]:
        return {names[f]: trees[f] for f in some}

    every = list(expressions)
    if computed is None:
        full = with_expressions(rows, columns(every), scope)
    else:
        full = computed.where("symbol is not null").select("symbol", "trade_date", *[F.col(f"`{f}`").alias(names[f]) for f in every])
    full = long(full.where(F.col("trade_date").isin(dates)), "whole", every)
    parts = []
    if near := [f for f in every if f in bounded]:
        parts.append(long(up_to_dates(rows, columns(near), dates), "cut", near))
    if far := [f for f in every if f not in bounded]:
        cut = up_to_dates(rows, columns(far), dates) if scope == "symbol" else _dates_ranked(rows, columns(far), dates)
        parts.append(long(cut, "cut", far))
    both = full.join(reduce(DataFrame.unionAll, parts), ["factor_id", "symbol", "trade_date"]).where("whole is not null and cut is not null")
    return both.groupBy("factor_id", "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("whole") - F.col("cut"))).alias("max_diff"),
        guarded_corr(F.col("whole"), F.col("cut"), lambda a: a).alias("correlation"),
    ).where("n >= 2")


def _dates_ranked(rows: DataFrame, trees: dict[str, Any], dates: list[Any]) -> DataFrame:
    """symbol, trade_date and expressions of date scope at each of dates, from copies of all rows up to it."""
    tags = F.array(*[F.lit(d) for d in dates])
    copies = rows.withColumn("__slice", F.explode(F.filter(tags, lambda d: d >= F.col("trade_date"))))
    both = {"symbol": F.struct(F.col("symbol").alias("of"), "__slice"), "trade_date": F.struct(F.col("trade_date").alias("day"), "__slice")}
    out = with_expressions(copies.withColumns(both).drop("__slice"), trees, "date").where("trade_date.day = trade_date.__slice")
    return out.select(F.col("symbol.of").alias("symbol"), F.col("trade_date.day").alias("trade_date"), *trees)


def check_all(factors: list[Factor], panel: DataFrame, config: QualityConfig | None = None, scope: str = "symbol", seed: int | None = 42) -> list[QualityResult]:
    """Results of all factors, in their order; seed as in truncation_dates."""
    c = config or QualityConfig()
    found = {f.factor_id: check_text(f, c) for f in factors}
    by_id = {f.factor_id: f for f in factors}
    alive = lambda: {i: by_id[i].expression for i, r in found.items() if r.passed}
    computed = None
    if alive():
        # read by the statistics and by the truncation test
        at = {f: f"__f{i}" for i, f in enumerate(alive())}
        computed = written(with_expressions(panel, {at[f]: e for f, e in alive().items()}, scope).select("symbol", "trade_date", *at.values()), "values")
        for s in value_stats(panel, alive(), scope, c, computed).collect():
            r = found[s["factor_id"]]
            r.valid_ratio = s["valid"]
            r.is_constant = s["sd"] is not None and s["sd"] < c.near_constant_threshold
            if not s["n"]:
                r.fail("execution", "no rows")
            elif not s["valid"]:
                r.fail("nan_constant", "no valid value")
            elif s["valid"] < c.min_valid_ratio or 1 - s["valid"] > c.max_nan_ratio:
                r.fail("nan_constant", f"valid share {s['valid']:.3f} is below {c.min_valid_ratio}")
            elif s["inf"]:
                r.fail("nan_constant", "an infinite value")
            elif r.is_constant:
                r.fail("nan_constant", "nearly constant")
    for i in alive():
        if len((by_id[i].description or "").strip()) < 10:
            found[i].fail("economic_logic", "the description is too short")
    if alive():
        dates = truncation_dates(panel, c.truncation_test_dates, seed)
        if not dates:
            for i in alive():
                found[i].warnings.append(f"fewer than {LEAST_DATES} dates: no truncation test")
        else:
            full = computed.select("symbol", "trade_date", *[F.col(at[f]).alias(f) for f in alive()])
            worst = truncation_test(panel, alive(), dates, scope, full).groupBy("factor_id").agg(F.max("max_diff").alias("d"), F.min("correlation").alias("r")).collect()
            for row in worst:
                if row["d"] > c.truncation_max_diff or (row["r"] is not None and row["r"] < c.truncation_min_corr):
                    found[row["factor_id"]].has_future_info = True
                    found[row["factor_id"]].fail("truncation", f"values change with later rows: by {row['d']:.3g}")
            if scope == "symbol":
                for i in alive():
                    if looks_at_whole_series(parse(by_id[i].expression)):
                        found[i].warnings.append("some function reads the symbol's whole history")
    for i in alive():
        if found[i].complexity > c.max_complexity:
            found[i].fail("complexity", f"{found[i].complexity} exceeds {c.max_complexity}")
    return list(found.values())


def bad_factors_rejected(panel: DataFrame, config: QualityConfig | None = None) -> dict[str, bool]:
    factors = [Factor(f"bad_{n}", n, e, description="a factor that must be rejected") for n, e in BAD_FACTORS.items()]
    return {f.name: not r.passed for f, r in zip(factors, check_all(factors, panel, config), strict=True)}


def forbidden_patterns() -> list[str]:
    return list(FORBIDDEN)
