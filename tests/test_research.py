import datetime
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import Config, PortfolioConfig, QualityConfig
from barloom.library import Factor, Registry, seed_factors
from barloom.operators import backtest, metrics, quality, scoring
from barloom.pipeline import PipelineRunner
from barloom.plans.compiler import evaluate_all, with_expressions
from barloom.sources.readers import DataRequest, SyntheticSource

DAYS = [d.date() for d in pd.bdate_range("2022-01-03", periods=40)]


def long(spark, rows):
    return spark.createDataFrame(rows, "factor_id string, symbol string, trade_date date, factor_value double, forward_return double")


def test_ic_of_monotone_vectors(spark):
    rows = [("f", str(i), DAYS[0], float(i), i * 2.0) for i in range(10)] + [("g", str(i), DAYS[0], float(i), -float(i**3)) for i in range(10)]
    rows += [("h", str(i), DAYS[0], float(i), float(i)) for i in range(4)] + [("k", str(i), DAYS[0], 1.0, float(i)) for i in range(10)]
    got = {r["factor_id"]: r for r in metrics.daily_ic(long(spark, rows)).collect()}
    assert got["f"]["ic"] == pytest.approx(1) and got["f"]["rankic"] == pytest.approx(1)
    assert got["g"]["rankic"] == pytest.approx(-1) and got["g"]["ic"] > -1
    assert "h" not in got  # fewer than five pairs
    assert got["k"]["ic"] is None and got["k"]["n"] == 10  # no variance


def test_summary(spark):
    d = spark.createDataFrame([("f", DAYS[0], 0.1, 0.2), ("f", DAYS[1], 0.3, 0.2), ("f", DAYS[2], None, 0.2), ("g", DAYS[0], 0.1, 0.1)], "factor_id string, trade_date date, ic double, rankic double")
    got = {r["factor_id"]: r for r in metrics.ic_summary(d).collect()}
    assert got["f"]["icir"] == pytest.approx(0.2 / np.std([0.1, 0.3], ddof=1)) and got["f"]["rankicir"] == 0.0
    assert got["f"]["n_valid_dates"] == 3 and got["f"]["positive_ic_ratio"] == pytest.approx(2 / 3)
    assert got["g"]["icir"] == 0.0 and got["g"]["ic_std"] == 0.0


def test_turnover_equals_pandas(spark):
    rng = np.random.default_rng(3)
    rows = [("f", s, d, None if rng.random() < 0.2 else float(rng.integers(0, 6)), 0.0) for s in "abcdef" for d in DAYS[:12] if rng.random() > 0.15]
    df = pd.DataFrame(rows, columns=["f", "symbol", "trade_date", "v", "r"]).dropna()
    ranks = df.pivot_table(index="trade_date", columns="symbol", values="v").rank(axis=1, pct=True)
    got = metrics.rank_turnover(long(spark, rows)).first()["turnover"]
    assert got == pytest.approx(ranks.diff().abs().mean().mean())
    assert metrics.all_metrics(long(spark, rows[:3])).first()["n_valid_dates"] == 0


def test_turnover_hashes_no_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f, s, d, None if rng.random() < 0.2 else float(rng.integers(0, 9)), 0.0) for f in "fg" for s in "abcdef" for d in DAYS[:9] if rng.random() > 0.2]
    for digits, unique in ((None, False), (9, True)):
        got = metrics.rank_turnover(long(spark, rows), digits, unique)
        assert not any("Aggregate [" in x and "symbol#" in x.split("]")[0] and "trade_date#" in x.split("]")[0] for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    plain, taken = ({r["factor_id"]: r["turnover"] for r in metrics.rank_turnover(long(spark, rows), None, u).collect()} for u in (False, True))
    assert plain == pytest.approx(taken) and len(plain) == 2
    # two values of a symbol on one date count as their mean
    twice = [(f, s, d, None if v is None else v + k, y) for f, s, d, v, y in rows for k in (-0.25, 0.25)]
    assert {r["factor_id"]: r["turnover"] for r in metrics.rank_turnover(long(spark, twice)).collect()} == pytest.approx(plain)


def test_metrics_of_unique_values_take_one_pass(spark):
    rng = np.random.default_rng(9)
    pick = lambda share, k: None if rng.random() < share else float(rng.integers(0, k)) / 3
    rows = [(f, s, d, pick(0.2, 9), pick(0.3, 5)) for f in "fgh" for s in "abcdefgh" for d in DAYS[:12] if rng.random() > 0.2]
    rows += [("few", s, DAYS[0], 1.0, 2.0) for s in "abc"] + [("none", "a", DAYS[0], None, 1.0)] + [("flat", s, d, 1.0, 2.0) for s in "abcdef" for d in DAYS[:3]]
    rows += [("unpaired", s, d, float(rng.random()), None) for s in "abcdef" for d in DAYS[:3]]
    df = long(spark, rows)
    plain, one = ({r["factor_id"]: r.asDict() for r in metrics.all_metrics(df, digits=9, unique=u).collect()} for u in (False, True))
    assert plain.keys() == one.keys() == {"f", "g", "h", "few", "none", "flat", "unpaired"}
    for f, want in plain.items():
        assert one[f].keys() == want.keys() and all(one[f][c] == (w if w is None or isinstance(w, str) else pytest.approx(w)) for c, w in want.items()), (f, one[f], want)
    sorts = [metrics.all_metrics(df, unique=u)._jdf.queryExecution().executedPlan().toString().count("Sort [factor_id#") for u in (False, True)]
    assert sorts[1] < sorts[0]


def test_values_are_written_before_they_become_long(spark):
    df = spark.createDataFrame([(s, d, float(i * 7 % 5 + 1)) for s in "ab" for i, d in enumerate(DAYS[:8])], "symbol string, trade_date date, close double")
    seen = []
    factors = {"x": ("ret(close, 1)", 1), "y": ("ts_mean(close, 3)", -1)}
    got = evaluate_all(df, factors, through=lambda wide: seen.append((wide.count(), "factor_id" in wide.columns)) or wide)
    assert seen == [(16, False)] and sorted(map(str, got.collect())) == sorted(map(str, evaluate_all(df, factors).collect()))


def test_gate_computes_all_rows_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "with_expressions", lambda *a: calls.append(1) or with_expressions(*a))
    days = [d.date() for d in pd.bdate_range("2022-01-03", periods=50)]
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(s, d, float(rng.random() + 1)) for s in "abcd" for d in days], "symbol string, trade_date date, close double")
    told = "a description that is long enough"
    out = quality.check_all([Factor("a", "a", "ret(close, 3)", description=told), Factor("b", "b", "rank(close)", description=told), Factor("c", "c", "close * 0", description=told)], df, seed=None)
    assert [(r.factor_id, r.stage) for r in out] == [("a", ""), ("b", "truncation"), ("c", "nan_constant")] and len(calls) == 1


def test_forward_return_over_gaps(spark):
    df = spark.createDataFrame([("a", DAYS[i], c) for i, c in enumerate([1.0, None, 2.0, 4.0])], "symbol string, trade_date date, close double")
    got = [r["forward_return"] for r in metrics.with_forward_return(df).orderBy("trade_date").collect()]
    assert got == [0.0, 1.0, 1.0, None]
    assert [r["forward_return"] for r in metrics.with_forward_return(df, fill=False).orderBy("trade_date").collect()] == [None, None, 1.0, None]


def test_scores(spark):
    cols = "factor_id string, ic_mean double, icir double, rankic_mean double, rankicir double"
    m = spark.createDataFrame([("a", 0.05, 0.5, 0.05, 0.5), ("b", 0.01, 0.1, 0.01, 0.1), ("c", -0.01, 0.0, None, 0.0)], cols)
    got = {r["factor_id"]: r for r in scoring.classify(scoring.composite_score(m)).collect()}
    # of rankic, two values are there and three rows: a's share is 1/2, and its mean 3.5 / 4
    assert got["a"]["composite_score"] == 0.875 and got["a"]["status"] == "elite"
    assert got["c"]["status"] == "rejected" and got["c"]["composite_score"] == 0.0
    assert scoring.composite_score(m.limit(1)).first()["composite_score"] == 0.5


def test_dedup(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9, 10), ("b", "c", -0.95, 10), ("a", "c", 0.1, 10)], "a string, b string, correlation double, n_dates long")
    kept, removed = scoring.numerical_dedup(["a", "b", "c"], pairs, {"a": {"score": 0.1}, "b": {"score": 0.9}, "c": {"score": 0.5}})
    # a gathers b, b stays; then b gathers c
    assert kept == ["b"] and removed == ["a", "c"]
    assert scoring.numerical_dedup(["a", "b"], pairs, {})[0] == ["a"]


def reference_backtest(values, panel, strategy, c):
    """A plain pandas account of the rules."""
    panel = panel.sort_values(["symbol", "trade_date"])
    panel["r"] = panel.groupby("symbol")["close"].pct_change()
    m = values.merge(panel[["symbol", "trade_date", "r"]])
    w = {}
    for d in sorted(m.trade_date.unique())[:: backtest.EVERY[c.rebalance]]:
        x = m[(m.trade_date == d) & m.factor_value.notna()].sort_values(["factor_value", "symbol"], ascending=[False, True])
        n = len(x)
        if not n:
            continue
        t, b = max(int(n * c.top_quantile), 1), max(int(n * c.bottom_quantile), 1)
        own = {}
        if strategy in ("top_quantile", "long_short"):
            own |= dict.fromkeys(x.symbol[:t], min(1 / t, c.max_single_weight))
        if strategy in ("bottom_quantile", "long_short"):
            own |= dict.fromkeys(x.symbol[-b:], min(1 / b, c.max_single_weight) * (-1 if strategy == "long_short" else 1))
        if strategy == "equal_weight":
            own = dict.fromkeys(x.symbol, 1 / n)
        w[d] = own
    rate = (c.transaction_cost_bps + c.slippage_bps) / 1e4
    rets = {d: sum(m[(m.trade_date == d) & (m.symbol == s)].r.fillna(0).sum() * v for s, v in own.items()) - rate * sum(map(abs, own.values())) for d, own in w.items()}
    r = pd.Series(rets)
    cum = (1 + r).cumprod() - 1
    moves = [sum(abs(b.get(s, 0) - a.get(s, 0)) for s in {*a, *b}) / 2 for a, b in zip(list(w.values())[:-1], list(w.values())[1:], strict=True)]
    return {"return_after_cost": cum.iloc[-1], "annual_volatility": r.std() * np.sqrt(252), "max_drawdown": (cum - cum.cummax()).min(), "turnover": np.mean(moves), "total_cost": rate * sum(sum(map(abs, o.values())) for o in w.values())}


@pytest.mark.parametrize("strategy", backtest.STRATEGIES)
@pytest.mark.parametrize("rebalance", ["daily", "weekly"])
def test_backtest(spark, strategy, rebalance):
    rng = np.random.default_rng(5)
    rows = [(s, d, float(np.exp(rng.normal(0, 0.1))) * 10, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for s in "abcdefghijkl" for d in DAYS]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double, factor_value double")
    c = PortfolioConfig(rebalance=rebalance)
    got = backtest.run(df.select("symbol", "trade_date", "factor_value"), df, strategy, c).first()
    pdf = pd.DataFrame(rows, columns=["symbol", "trade_date", "close", "factor_value"])
    for k, v in reference_backtest(pdf[["symbol", "trade_date", "factor_value"]], pdf[["symbol", "trade_date", "close"]].copy(), strategy, c).items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k
    assert got["return_before_cost"] == got["return_after_cost"] < got["gross_return"]


def test_backtest_of_nothing(spark):
    df = spark.createDataFrame([], "symbol string, trade_date date, close double, factor_value double")
    got = backtest.run(df.select("symbol", "trade_date", "factor_value"), df).first()
    assert got["n_days"] == 0 and got["sharpe_ratio"] == 0.0
    one = spark.createDataFrame([("a", DAYS[0], 1.0, 1.0)], df.schema)
    assert backtest.run(one.select("symbol", "trade_date", "factor_value"), one, "nonsense").first()["n_days"] == 0


@pytest.fixture(scope="module")
def synthetic(spark):
    return SyntheticSource(8).load(spark, DataRequest(start_date="2022-01-03", end_date="2022-06-30")).cache()


def test_gate(spark, synthetic):
    assert all(quality.bad_factors_rejected(synthetic).values())
    picked = [f for f in seed_factors() if f.factor_id in ("seed_001", "seed_013", "seed_021")]
    extra = [Factor("const", "const", "sub(close, close)", description="a constant factor"), Factor("plain", "plain", "close", description="short"), Factor("turn", "turn", "close", 2, description="direction is wrong"),
             Factor("long", "long", "close" + " + close" * 101, description="far too many parts")]
    got = {r.factor_id: r for r in quality.check_all(picked + extra, synthetic)}
    assert got["seed_001"].passed and got["seed_021"].stage == "truncation" and got["seed_021"].has_future_info
    assert got["const"].stage == "nan_constant" and got["plain"].stage == "economic_logic" and got["turn"].stage == "structure" and got["long"].stage == "complexity"
    by_date = quality.check_all([f for f in picked if f.factor_id == "seed_021"], synthetic, scope="date")
    assert by_date[0].stage != "truncation"  # across symbols of one date nothing leaks


def test_gate_on_a_short_panel(spark, synthetic):
    short = synthetic.where(F.col("trade_date") <= datetime.date(2022, 1, 20))
    got = quality.check_all([Factor("m", "m", "ts_mean(close, 3)", description="a mean of three")], short)
    assert got[0].passed and got[0].warnings


def test_gate_sees_later_symbols(spark):
    rows = [(f"s{i:03d}", d, float(i + j % 7 + 1), 1.0 if i < 25 else None, 1e-300 if i == 59 else 1.0) for i in range(60) for j, d in enumerate(DAYS)]
    panel = spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume double, open double")
    factors = [Factor("gaps", "gaps", "volume * close", description="missing from symbol 25 on"), Factor("inf", "inf", "close * 1e300 / open", description="infinite in the last symbol"),
               Factor("fine", "fine", "ts_mean(close, 3)", description="a mean of three")]
    got = {r.factor_id: r for r in quality.check_all(factors, panel)}
    assert got["gaps"].stage == got["inf"].stage == "nan_constant" and got["fine"].passed
    assert got["gaps"].valid_ratio == pytest.approx(25 / 60) and got["inf"].error == "an infinite value"
    few = quality.check_all(factors[:1], panel, QualityConfig(sample_rows=1000))
    assert few[0].passed and few[0].valid_ratio == 1.0


def test_pipeline(spark, tmp_path):
    c = Config.from_dict({"data": {"train_start": "2022-01-03", "train_end": "2022-04-29", "oos_start": "2022-05-02", "oos_end": "2022-06-30"}, "output_dir": str(tmp_path), "nonsense": 1})
    c.quality.truncation_test_dates = 2
    panel = SyntheticSource(12).load(spark, DataRequest(start_date=c.data.train_start, end_date=c.data.oos_end))
    seeds = [f for f in seed_factors() if f.factor_id in ("seed_006", "seed_009", "seed_010", "seed_019", "seed_021")]
    out = PipelineRunner(spark, c, Registry(seeds)).run(panel=panel)
    assert sum(out["status_counts"].values()) == 4 and len(out["oos"]) == 4 and len(out["portfolio"]) == 3
    names = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs}
    assert {"SHA256SUMS", "report/report.html", "report/summary.json", "oos/oos_metrics.csv", "data_manifest.json", "run_manifest.json", "environment.json"} <= names
    assert json.load(open(tmp_path / "report/summary.json"))["passed_quality"] == 4


def test_ties_at_any_size(spark):
    # 0.1 + 0.2 and 0.3 differ in their last bit only; small values differ in their first digits
    rows = [(0.1 + 0.2, 0.3), (3e-8, 3.1e-8), (-2e12, -2e12 - 1e-3), (0.0, -0.0), (float("inf"), float("inf")), (None, None), (1e-300, 1e-300)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [(r["a"], r["b"]) for r in df.select(metrics.tied(df.a).alias("a"), metrics.tied(df.b).alias("b")).collect()]
    assert [a == b for a, b in got] == [True, False, True, True, True, True, True]
    assert got[1][0] == pytest.approx(3e-8, rel=1e-9) and got[4][0] == float("inf") and got[6][0] == 1e-300
    small = [("f", f"s{i}", 1, i * 1e-8, float(i)) for i in range(6)]
    assert metrics.daily_ic(spark.createDataFrame(small, "factor_id string, symbol string, trade_date int, factor_value double, forward_return double")).first()["rankic"] == pytest.approx(1.0)


def test_ranks_take_values_as_they_are_by_default(spark):
    rows = [("f", f"s{i}", 1, 1.0 + i * 1e-10, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "factor_id string, symbol string, trade_date int, factor_value double, forward_return double")
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert metrics.daily_ic(df).first()["rankic"] == pytest.approx(1.0) and metrics.daily_ic(df, digits=9).first()["rankic"] is None
    assert metrics.all_metrics(df).first()["rankic_mean"] == pytest.approx(1.0)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
