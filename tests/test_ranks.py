"""Ranks by range partitions against windows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.series import average_rank
from barloom.operators import metrics, ranks


def rows(spark, n=900, ties=20):
    rnd = random.Random(4)
    pick = lambda: rnd.choice([None, 0.0, 0.0, 0.0, -0.0, float(rnd.randint(0, ties)), rnd.random()])
    data = [(rnd.choice(["a", "a", "a", "b", None]), i, pick(), pick(), "x") for i in range(n)]
    return spark.createDataFrame([*data, ("alone", n, 1.0, 2.0, "x"), ("empty", n + 1, None, 1.0, "x")], "g string, id int, v double, u double, `__n` string").repartition(6)


@pytest.mark.parametrize("parts", [1, 3, 16, 200])
def test_ranks_equal_windows(spark, parts):
    df = rows(spark)
    want = {r["id"]: (r["r"], r["n"]) for r in df.withColumns({"r": average_rank(F.col("v"), "g"), "n": F.expr("count(v) over (partition by g)")}).collect()}
    out = ranks.with_average_rank(df.drop("__n"), ["g"], "v", "r", parts, "n").collect()
    assert {r["id"]: (r["r"], r["n"]) for r in out} == want and len(out) == len(want)
    shares = {r["id"]: r["s"] for r in ranks.rank_by_range(df.drop("__n"), ["g"], "v", "s", parts).collect()}
    assert all((s is None) == (want[i][0] is None) and (s is None or math.isclose(s, want[i][0] / want[i][1])) for i, s in shares.items())


def test_rankic_equals_the_window_form(spark):
    df = rows(spark, 600).select(F.coalesce("g", F.lit("n")).alias("factor_id"), (F.col("id") % 3).alias("trade_date"), F.col("id").cast("string").alias("symbol"), F.col("v").alias("factor_value"), F.col("u").alias("forward_return"))
    want = {(r["factor_id"], r["trade_date"]): (r["rankic"], r["n"]) for r in metrics.daily_ic(df).collect()}
    got = {(r["factor_id"], r["trade_date"]): (r["rankic"], r["n"]) for r in ranks.daily_rankic(df, parts=8).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("most", [7, 60, 10_000])
def test_large_groups_are_cut_and_small_ones_are_not(spark, monkeypatch, most):
    df = rows(spark, 700, 5)
    want = {r["id"]: (r["r"], r["n"]) for r in df.withColumns({"r": average_rank(F.col("v"), "g"), "n": F.expr("count(v) over (partition by g)")}).collect()}
    monkeypatch.setattr(ranks, "ROWS", most)
    got = ranks.with_average_rank(df.drop("__n"), ["g"], "v", "r", count="n")
    assert {r["id"]: (r["r"], r["n"]) for r in got.collect()} == want
    pairs = df.select(F.lit("f").alias("factor_id"), F.coalesce("g", F.lit("n")).alias("trade_date"), F.col("v").alias("factor_value"), F.col("u").alias("forward_return"))
    plan = ranks.daily_rankic(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert ("__range" in plan) == (most < 300)


def test_one_date_of_many_symbols_is_dealt_evenly(spark):
    df = spark.range(0, 1_000_000).select(F.lit("2020-01-01").alias("trade_date"), F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.rand(7)).alias("v"))
    order = [F.col("trade_date"), F.col("v"), F.xxhash64(*df.columns)]
    sizes = sorted(r["count"] for r in df.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 1.5 * sizes[4]  # a third of the rows share one value
    out = ranks.with_average_rank(df, ["trade_date"], "v", "r", 8)
    got = out.agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.min("r").alias("low"), F.max("r").alias("high"), F.count_if(F.col("v") == 0).alias("zeros")).first()
    assert (got["n"], got["s"], got["low"], got["high"]) == (1_000_000, 1_000_000 * 1_000_001 / 2, (1 + got["zeros"]) / 2, 1_000_000.0)


def test_empty_tables(spark):
    assert ranks.with_average_rank(rows(spark).where("false"), ["g"], "v", "r", 4).count() == 0
