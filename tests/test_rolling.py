"""Long windows: running states of chunks against bounded frames and against numpy."""

import math
import random

import numpy as np
import pytest

from barloom.functions import rolling
from barloom.plans.compiler import with_expressions

FUNCTIONS = ["ts_sum(close, %d)", "ts_mean(close, %d)", "ts_std(close, %d)", "ts_min(close, %d)", "ts_max(close, %d)", "ts_rank(close, %d)", "corr(close, volume, %d)", "cov(close, volume, %d)"]


def bars(spark, n=400, scale=1.0, missing=0.1):
    rnd = random.Random(5)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(n if s != "c" else 3):
            close = None if rnd.random() < missing else scale * (1 + (i // 50) + round(rnd.random(), 1))
            rows.append((s, i, close, None if rnd.random() < missing else rnd.random() * 9 if i % 60 > 30 else 4.0))
    return spark.createDataFrame(rows, "symbol string, trade_date int, close double, volume double").repartition(3)


def close_to(a, b, tol=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or abs(a - b) <= tol * max(1, abs(a), abs(b))))


@pytest.mark.parametrize("n", [2, 7, 64, 399, 1000])
def test_chunks_equal_frames(spark, monkeypatch, n):
    names = {f"v{i}": f % n for i, f in enumerate(FUNCTIONS)}
    panel = bars(spark)
    want = {(r["symbol"], r["trade_date"]): r for r in with_frames(panel, names, monkeypatch)}
    monkeypatch.setattr(rolling, "LONG", 1)
    got = with_expressions(panel, names).collect()
    assert len(got) == len(want)
    for r in got:
        for v, e in names.items():
            assert close_to(r[v], want[r["symbol"], r["trade_date"]][v]), (e, r, want[r["symbol"], r["trade_date"]])


def with_frames(panel, names, monkeypatch):
    monkeypatch.setattr(rolling, "LONG", 10**9)
    return with_expressions(panel, names).collect()


def test_no_digits_are_lost_on_large_values(spark, monkeypatch):
    """Values near 1e15 that differ by single units, after a stretch of far larger ones."""
    monkeypatch.setattr(rolling, "LONG", 1)
    rnd = np.random.default_rng(1)
    close = np.concatenate([np.full(100, 1e18), 1e15 + rnd.integers(0, 9, 300)])
    panel = spark.createDataFrame([("a", i, float(x), float(-x)) for i, x in enumerate(close)], "symbol string, trade_date int, close double, volume double")
    got = with_expressions(panel, {"m": "ts_mean(close, 90)", "s": "ts_std(close, 90)", "c": "corr(close, volume, 90)"}).orderBy("trade_date").collect()
    for i in range(189, 400):
        # a sum of 90 such values, however taken, is a multiple of 16
        window = close[i - 89 : i + 1] - 1e15
        assert abs(got[i]["m"] - 1e15 - window.mean()) <= 16 and close_to(got[i]["s"], window.std(ddof=1), 1e-6) and close_to(got[i]["c"], -1.0, 1e-6)


def test_equal_values_have_no_spread(spark, monkeypatch):
    monkeypatch.setattr(rolling, "LONG", 1)
    panel = spark.createDataFrame([("a", i, 0.1 + 0.2, float(i)) for i in range(50)], "symbol string, trade_date int, close double, volume double")
    rows = with_expressions(panel, {"s": "ts_std(close, 8)", "c": "corr(close, volume, 8)"}).where("trade_date > 0").collect()
    assert {(r["s"], r["c"]) for r in rows} == {(0.0, None)}


def test_long_windows_nest_and_mix(spark, monkeypatch):
    names = {"a": "ts_mean(ts_std(close, 20), 30) - ts_rank(ts_max(volume, 25), 40)", "b": "ts_mean(close, 3) + ts_min(ret(close, 2), 30)", "c": "corr(ts_rank(close, 30), volume, 30)"}
    panel = bars(spark, 150)
    want = {(r["symbol"], r["trade_date"]): r for r in with_frames(panel, names, monkeypatch)}
    monkeypatch.setattr(rolling, "LONG", 10)
    for r in with_expressions(panel, names).collect():
        assert all(close_to(r[v], want[r["symbol"], r["trade_date"]][v]) for v in names)


def test_infinite_values(spark, monkeypatch):
    monkeypatch.setattr(rolling, "LONG", 1)
    panel = spark.createDataFrame([("a", i, math.inf if i == 5 else float(i), 1.0) for i in range(20)], "symbol string, trade_date int, close double, volume double")
    got = {r["trade_date"]: (r["s"], r["x"]) for r in with_expressions(panel, {"s": "ts_sum(close, 4)", "x": "ts_max(close, 4)"}).collect()}
    assert [i for i, (s, _) in got.items() if s == math.inf] == [5, 6, 7, 8] and got[9] == (6.0 + 7 + 8 + 9, 9.0)


def test_windows_keep_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(rolling, "LONG", 10)
    plan = with_expressions(bars(spark), {"a": "ts_std(ts_mean(close, 30), 20)"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(symbol") == 1
