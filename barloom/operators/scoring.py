"""Composite scores, classes, deduplication and out-of-sample pairing of factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import FactorConfig
from barloom.functions.series import guarded_corr

SCORED = ["ic_mean", "icir", "rankic_mean", "rankicir"]


def composite_score(metrics: DataFrame) -> DataFrame:
    """Adds composite_score: mean over SCORED of the share of other factors with a smaller value (0.5 for a single
    factor, 0 for a missing value). Factors are a small table, so one window over all of them is right."""
    n = F.count(F.lit(1)).over(Window.partitionBy())

    def share(c: str) -> Column:
        place = F.percent_rank().over(Window.orderBy(F.col(c).asc_nulls_last()))
        return F.when(n == 1, F.lit(0.5)).when(F.col(c).isNull(), F.lit(0.0)).otherwise(place)

    total = sum((share(c) for c in SCORED[1:]), share(SCORED[0]))
    return metrics.withColumn("composite_score", total / 4)


def classify(scored: DataFrame, config: FactorConfig | None = None) -> DataFrame:
    c = config or FactorConfig()

    def reaches(score: float, least: list[float]) -> Column:
        ok = F.col("composite_score") >= score
        for name, value in zip(SCORED, least, strict=True):
            ok = ok & (F.col(name) >= value)
        return ok

    status = F.when(reaches(c.elite_score_threshold, c.least("elite")), "elite").when(reaches(c.qualified_score_threshold, c.least("qualified")), "qualified").otherwise("rejected")
    return scored.withColumn("status", status)


def status_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def structural_duplicates(factors: DataFrame) -> DataFrame:
    """factors: pos (distinct), factor_id, expression. Adds expression_hash and is_first (the first of its expression). The least pos
    of each expression is found before the shuffle, so that one that many factors share does not meet in a task."""
    h = F.sha2(F.regexp_replace(F.lower("expression"), r"\s+", ""), 256)
    hashed = factors.withColumn("expression_hash", h)
    least = hashed.groupBy(F.col("expression_hash").alias("__hash")).agg(F.min("pos").alias("__least"))
    out = hashed.join(least, F.col("expression_hash").eqNullSafe(F.col("__hash")))
    return out.withColumn("is_first", F.col("pos") == F.col("__least")).drop("__hash", "__least")


def daily_means(values: DataFrame) -> DataFrame:
    return values.groupBy("factor_id", "trade_date").agg(F.avg("factor_value").alias("mean_value"))


def correlation_pairs(means: DataFrame) -> DataFrame:
    """Correlation of the daily means of each two factors over their common dates; NULL where undefined."""
    have = means.where("mean_value is not null")
    a = have.select(F.col("factor_id").alias("a"), "trade_date", F.col("mean_value").alias("x"))
    b = have.select(F.col("factor_id").alias("b"), "trade_date", F.col("mean_value").alias("y"))
    pairs = a.join(b, (a.trade_date == b.trade_date) & (F.col("a") < F.col("b")))
    return pairs.groupBy("a", "b").agg(guarded_corr(F.col("x"), F.col("y"), lambda c: c).alias("correlation"), F.count(F.lit(1)).alias("n_dates"))


def numerical_dedup(order: list[str], pairs: DataFrame, info: dict[str, dict[str, float]], threshold: float = 0.85) -> tuple[list[str], list[str]]:
    """Kept and removed factor ids, both in order.

    Walking the list, a factor not yet removed gathers all later ones not yet removed that correlate with it at
    the threshold or above; the best of them stays (highest score, then shortest expression, highest coverage,
    lowest turnover, first in order). pairs holds a row for two factors at most, so it is small.
    """
    close = {(r["a"], r["b"]) for r in pairs.where(F.abs("correlation") >= threshold).select("a", "b").collect()}
    removed: set[str] = set()

    def key(f: str) -> tuple:
        i = info.get(f, {})
        return (-i.get("score", 0.0), i.get("length", 999), -i.get("coverage", 0.0), i.get("turnover", 1.0), order.index(f))

    for i, f in enumerate(order):
        if f in removed:
            continue
        group = [f] + [g for g in order[i + 1 :] if g not in removed and ((f, g) in close or (g, f) in close)]
        removed |= set(group) - {min(group, key=key)}
    return [f for f in order if f not in removed], [f for f in order if f in removed]


def oos_pairing(train: DataFrame, oos: DataFrame) -> DataFrame:
    """Out-of-sample metrics with the train IC, its decay and whether both have the same sign (0 counts as positive)."""
    t = train.select("factor_id", F.coalesce("ic_mean", F.lit(0.0)).alias("train_ic"))
    ic = F.coalesce("ic_mean", F.lit(0.0))
    decay = F.coalesce((F.col("train_ic") - ic) / F.nullif(F.abs("train_ic"), F.lit(0.0)), F.lit(0.0))
    return oos.join(t, "factor_id").withColumns({"oos_ic": ic, "decay_ratio": decay, "sign_consistent": (F.col("train_ic") >= 0) == (ic >= 0)})
