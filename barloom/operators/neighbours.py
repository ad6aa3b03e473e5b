"""Correlated factors among many, and the walk that keeps one of each group.

All pairs of F factors over D dates are F * F * D / 2 rows as a join. Here each factor is one row, a vector of daily means; factors are dealt to blocks, and every
two blocks meet once as matrices: sums of products over common dates come from matrix products, and only pairs that reach the
threshold leave the task. The walk over the factors in their order runs in rounds over those pairs: a factor is decided as soon as no
undecided earlier one shares a neighbour with it, so that far-off parts of the graph are decided at once. Factors never pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.shared import written

#: Factors of a block, about (memory of a task: two blocks times the dates).
BLOCK = 256
MAX_ROUNDS = 10_000


def close_pairs(means: DataFrame, threshold: float | None = None, block: int = BLOCK) -> DataFrame:
    """a, b, correlation, n_dates of any two factors (a < b) whose daily means correlate at threshold or above in absolute value over their common dates
    (None: of all pairs, undefined correlations as null). means: factor_id, trade_date, mean_value, one row for each factor and date; missing and NaN means count as none."""
    have = means.where("mean_value is not null and not isnan(mean_value)")
    vectors = written(have.groupBy("factor_id").agg(F.collect_list(F.struct(F.col("trade_date").cast("string").alias("day"), "mean_value")).alias("of")), "vectors")
    blocks = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64("factor_id"), F.lit(blocks)).cast("int")
    dealt = vectors.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"low": F.least("own", "with"), "high": F.greatest("own", "with")}).drop("with")

    def met(key: tuple, them: pd.DataFrame) -> pd.DataFrame:
        return _met(key, them, threshold)

    return dealt.groupBy("low", "high").applyInPandas(met, "a string, b string, correlation double, n_dates long")


def _met(key: tuple, them: pd.DataFrame, threshold: float | None) -> pd.DataFrame:
    low, high = key
    days = {}
    for of in them["of"]:
        for x in of:
            days.setdefault(x["day"], len(days))
    x = np.zeros((len(days), len(them)))
    mask = np.zeros_like(x)
    for i, of in enumerate(them["of"]):
        at = [days[v["day"]] for v in of]
        values = np.array([v["mean_value"] for v in of])
        x[at, i], mask[at, i] = values - values.mean(), 1.0  # less its mean: sums of squares then keep their digits
    one, two = (np.flatnonzero(them["own"].to_numpy() == k) for k in (low, high))
    xa, ma, xb, mb = x[:, one], mask[:, one], x[:, two], mask[:, two]
    with np.errstate(invalid="ignore", divide="ignore"):
        n = ma.T @ mb
        sa, sb = xa.T @ mb, ma.T @ xb
        qa, qb = (xa**2).T @ mb, ma.T @ xb**2
        va, vb = qa - sa * sa / n, qb - sb * sb / n
        r = (xa.T @ xb - sa * sb / n) / np.sqrt(va * vb)
        unsure = (n > 0) & ((va <= 1e-9 * qa) | (vb <= 1e-9 * qb) | ~np.isfinite(r))
    for i, j in np.argwhere(unsure):  # hardly any spread on the common dates: these are computed one by one
        common = (ma[:, i] > 0) & (mb[:, j] > 0)
        p, q = xa[common, i], xb[common, j]
        p, q = p - p.mean(), q - q.mean()
        root = np.sqrt((p @ p) * (q @ q))
        r[i, j] = p @ q / root if common.sum() > 1 and root > 0 else np.nan
    names = them["factor_id"].to_numpy()
    first, second = np.meshgrid(names[one], names[two], indexing="ij")
    taken = (n > 0) & (first != second) & ((first < second) | (low != high))
    if threshold is not None:
        with np.errstate(invalid="ignore"):
            taken &= np.abs(r) >= threshold
    a, b = first[taken], second[taken]
    value = pd.array(r[taken], dtype="Float64")
    value[np.isnan(r[taken])] = pd.NA
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "correlation": value, "n_dates": n[taken].astype(np.int64)})


def keep_best(factors: DataFrame, pairs: DataFrame) -> DataFrame:
    """factor_id, kept. factors: factor_id, pos (distinct), score, length, coverage, turnover. pairs: a, b, the close pairs.

    As scoring.numerical_dedup: walking by pos, a factor not yet removed gathers all later ones not yet removed that are close to it, and the best of them stays
    (highest score, then shortest, highest coverage, lowest turnover, first).
    """
    value = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    merit = F.struct((-value("score", 0.0)).alias("s"), value("length", 999).alias("l"), (-value("coverage", 0.0)).alias("c"), value("turnover", 1.0).alias("t"), F.col("pos").alias("p"))
    nodes = written(factors.select("factor_id", "pos", merit.alias("merit")), "nodes")
    at = lambda c, to: nodes.select(F.col("factor_id").alias(c), F.col("pos").alias(to), F.col("merit").alias(f"{to}_merit"))
    edges = pairs.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y")
    ends = [("x", "y"), ("y", "x")]
    both = [edges.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col(f"{v}_merit").alias("v_merit")) for u, v in ends]
    edges = written(both[0].unionAll(both[1]).distinct(), "edges")
    # factors without neighbours stay; state: undecided (null), whether removed
    state = written(edges.select("u").distinct().select(F.col("u").alias("pos"), F.lit(False).alias("done"), F.lit(False).alias("removed")), "state")
    merits = nodes.select("pos", "merit")
    for _ in range(MAX_ROUNDS):
        # what is removed before its turn takes no part any more
        live = state.where("not removed")
        open_ = live.where("not done").select("pos")
        if open_.isEmpty():
            break
        left = edges.join(live.select(F.col("pos").alias("u")), "u", "left_semi").join(live.select(F.col("pos").alias("v")), "v", "left_semi")
        # the first undecided one around each factor, then around its neighbours: those that are first there themselves are decided now
        near = _first_around(live.select("pos").join(open_.withColumn("first", F.col("pos")), "pos", "left"), left)
        two = _first_around(near, left)
        turn = open_.join(two, "pos").where(F.col("pos") == F.col("first")).select("pos")
        later = left.join(turn.withColumnRenamed("pos", "u"), "u").where("v > u").select(F.col("u").alias("of"), F.col("v").alias("pos"), F.col("v_merit").alias("merit"))
        group = later.unionByName(turn.join(merits, "pos").select(F.col("pos").alias("of"), "pos", "merit"))
        best = group.groupBy("of").agg(F.min("merit").alias("best"))
        gone = group.join(best, "of").where(F.col("merit") != F.col("best")).select("pos").distinct()
        marks = turn.select("pos", F.lit(True).alias("turn")).join(gone.select("pos", F.lit(True).alias("gone")), "pos", "full")
        state = written(
            state.join(marks, "pos", "left").select("pos", (F.col("done") | F.coalesce("turn", F.lit(False))).alias("done"), (F.col("removed") | F.coalesce("gone", F.lit(False))).alias("removed")), "state"
        )
    else:
        raise RuntimeError(f"the walk did not end in {MAX_ROUNDS} rounds")
    out = nodes.join(state, "pos", "left")
    return out.select("factor_id", (~F.coalesce("removed", F.lit(False))).alias("kept"))


def _first_around(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pos, first: the least `first` of each node and its neighbours."""
    seen: Column = F.col("first").isNotNull()
    beside = edges.join(nodes.where(seen).withColumnRenamed("pos", "v"), "v").select(F.col("u").alias("pos"), "first")
    return nodes.unionByName(beside).groupBy("pos").agg(F.min("first").alias("first"))
