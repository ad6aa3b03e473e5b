"""Block correlations against numpy, and the walk in rounds against the walk one by one."""

import random

import numpy as np
import pytest

from barloom.operators import neighbours, scoring


def vectors(n, days, seed=1):
    """Daily means with planted near copies, missing dates, constants and opposite signs."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, days)) + rng.normal(size=(n, 1)) * 1e6
    for i in range(0, n - 1, 7):
        x[i + 1] = (1 if i % 2 else -1) * x[i] + rng.normal(size=days) * 0.3
    x[5] = 0.1 + 0.2
    x[rng.random(x.shape) < 0.1] = np.nan
    x[9, :] = np.nan
    x[10, 1:] = np.nan
    return x


def table(spark, x):
    rows = [(f"f{i:05}", j, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "factor_id string, trade_date int, mean_value double")


def test_pairs_equal_the_join(spark):
    means = table(spark, vectors(40, 25))
    want = {(r["a"], r["b"]): (r["correlation"], r["n_dates"]) for r in scoring.correlation_pairs(means).collect()}
    for block in (3, 16, 1000):
        rows = neighbours.close_pairs(means, None, block).collect()
        got = {(r["a"], r["b"]): (r["correlation"], r["n_dates"]) for r in rows}
        assert got.keys() == want.keys() and len(rows) == len(got)
        for k, (r, n) in want.items():
            assert got[k][1] == n and ((r is None) == (got[k][0] is None)) and (r is None or abs(r - got[k][0]) < 1e-6), (k, r, got[k])


def test_five_thousand_factors(spark):
    x = np.random.default_rng(2).normal(size=(5000, 40))
    for i in range(0, 4999, 5):
        x[i + 1] = x[i] + np.random.default_rng(i).normal(size=40) * 0.2
    spread = x - x.mean(axis=1, keepdims=True)
    spread /= np.sqrt((spread**2).sum(axis=1, keepdims=True))
    r = spread @ spread.T
    i, j = np.nonzero(np.triu(np.abs(r) >= 0.85, 1))
    rows = spark.createDataFrame([(f"f{i:05}", row.tolist()) for i, row in enumerate(x)], "factor_id string, of array<double>")
    means = rows.selectExpr("factor_id", "posexplode(of) as (trade_date, mean_value)")
    got = {(a["a"], a["b"]) for a in neighbours.close_pairs(means, 0.85).collect()}
    assert got == {(f"f{a:05}", f"f{b:05}") for a, b in zip(i, j, strict=True)} and len(got) > 900


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_the_walk(spark, seed):
    rnd = random.Random(seed)
    names = [f"f{i:02}" for i in range(45)]
    order = rnd.sample(names, len(names))
    edges = sorted({tuple(sorted(rnd.sample(names, 2))) for _ in range(60)})
    info = {f: {"score": rnd.choice([0.1, 0.5, 0.9]), "length": rnd.randint(1, 3), "coverage": rnd.choice([0.5, 1.0]), "turnover": rnd.choice([0.1, 0.2])} for f in names if rnd.random() < 0.9}
    pairs = spark.createDataFrame([(a, b, 0.9, 5) for a, b in edges], "a string, b string, correlation double, n_dates long")
    rows = [(f, i, *(info.get(f, {}).get(k) for k in ("score", "length", "coverage", "turnover"))) for i, f in enumerate(order)]
    factors = spark.createDataFrame(rows, "factor_id string, pos int, score double, length int, coverage double, turnover double")
    kept, removed = scoring.numerical_dedup(order, pairs, info)
    got = {r["factor_id"]: r["kept"] for r in neighbours.keep_best(factors, pairs).collect()}
    assert got == {**dict.fromkeys(kept, True), **dict.fromkeys(removed, False)} and removed


def test_no_pairs_and_no_factors(spark):
    factors = spark.createDataFrame([("f", 0, 0.1, 1, 1.0, 0.0)], "factor_id string, pos int, score double, length int, coverage double, turnover double")
    none = spark.createDataFrame([], "a string, b string")
    assert [tuple(r) for r in neighbours.keep_best(factors, none).collect()] == [("f", True)]
    assert neighbours.keep_best(factors.where("false"), none).count() == 0
    assert neighbours.close_pairs(table(spark, np.zeros((0, 3))), 0.5).count() == 0
