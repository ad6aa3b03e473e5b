import numpy as np
import pandas as pd
import pytest

from barloom.library import Factor, Registry, seed_factors
from barloom.plans.compiler import evaluate, with_expressions
from barloom.plans.expressions import ARITY, ExpressionError, ForbiddenExpression, complexity, expression_hash, parse, validate


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    rows = []
    for s in ("A", "B", "C"):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
        close[7] = np.nan
        close[20:24] = close[19]  # ties and no variance
        for d, c in zip(pd.bdate_range("2020-01-01", periods=60), close, strict=True):
            rows.append((s, d.date(), c * 0.99, c * 1.02, c * 0.97, c, float(rng.integers(1, 100)), 1.0))
    return pd.DataFrame(rows, columns=["symbol", "trade_date", "open", "high", "low", "close", "volume", "amount"])


@pytest.fixture(scope="module")
def panel(spark, frame):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double").repartition(3).cache()


PANDAS = {
    "delay(close, 2)": lambda g: g.close.shift(2),
    "delta(close)": lambda g: g.close.diff(1),
    "ret(close, 3)": lambda g: g.close.pct_change(3, fill_method=None),
    "ts_mean(close, 5)": lambda g: g.close.rolling(5, min_periods=1).mean(),
    "ts_sum(volume, 5)": lambda g: g.volume.rolling(5, min_periods=1).sum(),
    "ts_std(close, 5)": lambda g: g.close.rolling(5, min_periods=1).std(),
    "ts_min(close, 5)": lambda g: g.close.rolling(5, min_periods=1).min(),
    "ts_max(close, 5)": lambda g: g.close.rolling(5, min_periods=1).max(),
    "ts_rank(close, 5)": lambda g: g.close.rolling(5, min_periods=1).rank(pct=True),
    "cov(close, volume, 6)": lambda g: g.close.rolling(6, min_periods=2).cov(g.volume),
    "rank(close)": lambda g: g.close.rank(pct=True),
    "zscore(close)": lambda g: (g.close - g.close.mean()) / g.close.std(),
    "winsorize(close, 1)": lambda g: g.close.clip(g.close.mean() - g.close.std(), g.close.mean() + g.close.std()),
    "log1p(close - open * 1.01)": lambda g: np.log1p((g.close - g.open * 1.01).abs()) * np.sign(g.close - g.open * 1.01),
    "where(close > 50, 1, 0 - 1)": lambda g: pd.Series(np.where(g.close > 50, 1.0, -1.0), g.index),
    "min(close, delay(close, 1))": lambda g: pd.Series(np.minimum(g.close, g.close.shift(1)), g.index),
    "close / (high - high)": lambda g: pd.Series(np.nan, g.index),
    "(close != close) + (close < 0)": lambda g: (g.close != g.close).astype(float) + (g.close < 0).astype(float),
    "ts_mean(ts_std(ret(close, 1), 4), 6)": lambda g: g.close.pct_change(fill_method=None).rolling(4, min_periods=1).std().rolling(6, min_periods=1).mean(),
}


def test_functions_equal_pandas(panel, frame):
    got = with_expressions(panel, {f"e{i}": e for i, e in enumerate(PANDAS)}).toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    for i, (e, f) in enumerate(PANDAS.items()):
        want = pd.concat([f(g) for _, g in frame.groupby("symbol")]).to_numpy(float)
        np.testing.assert_allclose(got[f"e{i}"].to_numpy(float), want, rtol=1e-9, atol=1e-12, err_msg=e)


def test_corr_equals_pandas_where_there_is_variance(panel, frame):
    got = evaluate(panel, "corr(close, volume, 10)").toPandas().sort_values(["symbol", "trade_date"])["factor_value"].to_numpy(float)
    want = pd.concat([g.close.rolling(10, min_periods=2).corr(g.volume) for _, g in frame.groupby("symbol")]).to_numpy(float)
    both = ~np.isnan(got) & ~np.isnan(want)
    assert both.sum() > 100
    np.testing.assert_allclose(got[both], want[both], atol=1e-9)


def test_date_scope_ranks_across_symbols(panel):
    got = evaluate(panel, "rank(volume)", scope="date").toPandas()
    assert (got.groupby("trade_date")["factor_value"].max() <= 1).all()
    assert got.groupby("trade_date")["factor_value"].mean().round(6).nunique() == 1


def test_one_exchange_for_many_expressions(panel):
    plan = with_expressions(panel, {f.factor_id: f.expression for f in seed_factors() if "rank" not in f.expression})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


@pytest.mark.parametrize("bad", ["", "  ", "foo(close)", "close.shift(-1)", "__import__('os')", "delay(close, -1)", "ret(close, -1)", "delta(close, -2)", "ts_mean(close, 0)", "ts_mean(close, volume)",
                                 "close // 2", "not close", "[close]", "close if open else high", "lambda: close", "delay(x=close)", "close(1)", "price", "'a'", "ts_mean(close)", "close @ open", "True"])
def test_rejects(bad):
    assert not validate(bad)[0]
    with pytest.raises(ExpressionError):
        parse(bad)


def test_every_function_is_accepted():
    for name, (least, _) in ARITY.items():
        args = ["close", "close", "close"][: least]
        if name in ("delay", "ts_mean", "ts_sum", "ts_std", "ts_min", "ts_max", "ts_rank", "corr", "cov"):
            args[-1] = "5"
        assert validate(f"{name}({', '.join(args)})") == (True, ""), name


def test_forbidden_is_its_own_error():
    with pytest.raises(ForbiddenExpression):
        parse("eval(close)")


def test_hash_ignores_case_and_space():
    assert expression_hash("ADD(close, open)") == expression_hash("add( close,open )")
    assert complexity("add(close, 1e-8) * 2") == 3


def test_errors_can_become_nulls(panel):
    assert evaluate(panel, "shift(close, 1)", on_error="null").where("factor_value is not null").count() == 0
    with pytest.raises(ValueError):
        evaluate(panel.drop("amount"), "amount")


def test_registry(panel):
    r = Registry(seed_factors())
    assert r.count() == 21
    assert not r.register(Factor("again", "again", "ts_min( RET(close,1), 60)".lower()))
    assert r.register(Factor("bad", "bad", "nope(close)"))
    assert len(r.filter_by_level(1)) == 3
    long = r.evaluate_all(panel)
    assert long.select("factor_id").distinct().count() == 21
    a = {tuple(x) for x in long.where("factor_id = 'seed_011'").select("symbol", "trade_date", "factor_value").collect()}
    assert a == {tuple(x) for x in r.evaluate_factor("seed_011", panel).collect()}


def test_empty_panel(panel):
    assert evaluate(panel.limit(0), "ts_rank(close, 5)").count() == 0
