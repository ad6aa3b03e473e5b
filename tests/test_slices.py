"""Slices of a symbol's history against the plain plan, and the truncation test against one run for each date."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling
from barloom.operators.quality import truncation_dates, truncation_test
from barloom.plans.compiler import with_expressions
from barloom.plans.expressions import parse
from barloom.plans.slices import look_back, sliceable, sliced, up_to_dates, with_slices
from barloom.sources.panels import bars_events

EXPRESSIONS = {"a": "ts_mean(close, 7) - delay(close, 5)", "b": "ts_rank(ts_std(close, 4), 6)", "c": "corr(close, ret(volume, 3), 12)", "d": "close + 1"}


def bars(spark, n=600, seed=3):
    rnd = random.Random(seed)
    symbols = ["hot"] * 6 + ["b", "c", None, "d"]
    rows = [(rnd.choice(symbols), i, None if rnd.random() < 0.1 else rnd.random(), float(rnd.randint(1, 9)), "kept") for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, trade_date int, close double, volume double, __slice_no string").repartition(5)


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_look_back():
    assert look_back(parse("close")) == 0 and look_back(parse("delay(ts_mean(close, 5), 3)")) == 7
    assert look_back(parse("corr(ret(close, 2), delay(close, 9), 10) + ts_sum(volume, 4)")) == 18
    assert look_back(parse("rank(close)")) is None and look_back(parse("ts_mean(zscore(close), 3)")) is None
    assert sliceable(EXPRESSIONS) and not sliceable({"x": "winsorize(close, 2)"})


@pytest.mark.parametrize(("slices", "long"), [(1, 64), (4, 64), (90, 64), (4, 2), (400, 5)])
def test_slices_equal_the_plain_plan(spark, monkeypatch, slices, long):
    panel = bars(spark)
    want = {r["trade_date"]: r for r in with_expressions(panel, EXPRESSIONS).collect()}
    monkeypatch.setattr(rolling, "LONG", long)
    got = with_slices(panel, EXPRESSIONS, slices)
    assert got.columns == [*panel.columns, *EXPRESSIONS]
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["trade_date"]]
        assert r["symbol"] == w["symbol"] and all(same(r[c], w[c]) for c in EXPRESSIONS), (r, w)


def test_slices_of_a_hot_symbol_are_even(spark):
    panel = bars_events(spark, "/root/testdata/sf0.01")
    assert panel.where("symbol = 'all'").count() > panel.count() / 4
    sizes = sorted(r["count"] for r in sliced(panel, 50, 16).groupBy("__slice").count().collect())
    assert len(sizes) == 16 and sum(sizes) <= panel.count() + 50 * 32
    assert sizes[-1] < 2 * sizes[8]  # the largest task's rows are near the median's


def test_slices_refuse_whole_series_and_take_empty_panels(spark):
    with pytest.raises(ValueError, match="look-back"):
        with_slices(bars(spark), {"x": "rank(close)"})
    assert with_slices(bars(spark).where("false"), EXPRESSIONS).count() == 0


def test_values_up_to_dates(spark):
    panel = bars(spark, 200).where("symbol is not null")
    dates = [0, 31, 32, 33, 150, 199, 500]
    got = {(r["symbol"], r["trade_date"]): r for r in up_to_dates(panel, EXPRESSIONS, dates).collect()}
    want = {}
    for d in dates:
        for r in with_expressions(panel.where(F.col("trade_date") <= d), EXPRESSIONS).where(F.col("trade_date") == d).collect():
            want[r["symbol"], r["trade_date"]] = r
    assert got.keys() == want.keys() and want
    assert all(same(got[k][c], want[k][c]) for k in want for c in EXPRESSIONS)


def dated(spark, days=60):
    rnd = random.Random(8)
    start = datetime.date(2020, 1, 1)
    rows = [(s, start + datetime.timedelta(i), rnd.random(), 1.0) for s in "abcdef" for i in range(days) if rnd.random() < 0.9]
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume double")


def test_truncation_finds_whole_series_functions_only(spark):
    panel = dated(spark)
    dates = truncation_dates(panel, 10, None)
    assert len(dates) == 10 and dates == sorted(set(dates)) and truncation_dates(panel, 99, None) == truncation_dates(panel, 99)
    out = {}
    for r in truncation_test(panel, {"plain": "ts_mean(close, 9)", "whole": "rank(close)"}, dates).collect():
        out.setdefault(r["factor_id"], []).append(r)
    assert len(out["plain"]) == len(out["whole"]) == 10
    assert all(r["max_diff"] < 1e-12 and r["correlation"] > 1 - 1e-9 for r in out["plain"])
    assert max(r["max_diff"] for r in out["whole"]) > 1e-3 and min(r["correlation"] for r in out["whole"]) < 1 - 1e-6


def test_truncation_of_bounded_functions_is_one_pass(spark):
    panel = dated(spark)
    plans = [truncation_test(panel, {"a": "ts_mean(close, 9)"}, truncation_dates(panel, k, None))._jdf.queryExecution().optimizedPlan().toString().count("Window") for k in (2, 10)]
    assert plans[0] == plans[1]


EVERY = EXPRESSIONS | {
    "e": "rank(close) * 2 - zscore(close)", "f": "winsorize(close, 1) + delta(close, 3) / volume", "g": "ts_mean(rank(close), 3) + cov(close, volume, 5)", "h": "where(ts_min(close, 4) > ts_sum(volume, 2) / 20, ret(volume, 2), ts_max(close, 8))",
    "i": "rank(ts_std(ret(volume, 1), 6)) > 0.5 or close < 0.2", "j": "ts_rank(volume, 20) + delay(close, 0) + corr(rank(close), volume, 9) + ts_mean(close, 80)",
}


def test_values_up_to_dates_of_whole_histories(spark):
    panel = bars(spark, 300).where("symbol is not null")
    dates = [0, 31, 33, 150, 299, 500]
    got = {(r["symbol"], r["trade_date"]): r for r in up_to_dates(panel, EVERY, dates).collect()}
    want = {}
    for d in dates:
        for r in with_expressions(panel.where(F.col("trade_date") <= d), EVERY).where(F.col("trade_date") == d).collect():
            want[r["symbol"], r["trade_date"]] = r
    assert got.keys() == want.keys() and want
    assert all(same(got[k][c], want[k][c]) for k in want for c in EVERY)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outer_windows_are_aggregates_at_test_dates(spark):
    panel = dated(spark)
    plan = optimized(up_to_dates(panel, {"a": "ts_std(ts_mean(close, 9), 31)"}, truncation_dates(panel, 10, None)))
    assert "RowFrame, -8" in plan and "RowFrame, -30" not in plan


@pytest.mark.parametrize("scope", ["symbol", "date"])
def test_truncation_of_whole_histories_is_one_pass(spark, scope):
    panel = dated(spark)
    e = {"x": "rank(close)", "y": "mul(rank(ret(close, 5)), rank(close))"}
    assert len({optimized(truncation_test(panel, e, truncation_dates(panel, k, None), scope)).count("Window") for k in (2, 10)}) == 1
    dates = truncation_dates(panel, 3, None)
    got = {(r["factor_id"], r["trade_date"]): r for r in truncation_test(panel, e, dates, scope).collect()}
    full = with_expressions(panel, e, scope)
    for d in dates:
        cut = with_expressions(panel.where(F.col("trade_date") <= F.lit(d)), e, scope).select("symbol", "trade_date", *[F.col(f).alias(f"cut_{f}") for f in e])
        both = full.join(cut.where(F.col("trade_date") == F.lit(d)), ["symbol", "trade_date"])
        for f in e:
            w = both.where(f"{f} is not null and cut_{f} is not null").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(f) - F.col(f"cut_{f}"))).alias("m")).first()
            assert got[f, d]["n"] == w["n"] and same(got[f, d]["max_diff"], w["m"])
