"""Quantile portfolio back-tests with costs. Research only.

By default weights act on the return of the very day whose factor formed them, returns exist on rebalance dates
alone, and costs are charged on gross weight at each of them; `lag_weights` moves weights to the next bar. The
summary's return_before_cost equals the return after cost; gross_return is the one before costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import PortfolioConfig
from barloom.panel import by_date

STRATEGIES = ("top_quantile", "bottom_quantile", "long_short", "equal_weight")
EVERY = {"daily": 1, "weekly": 5, "monthly": 21}


def with_daily_return(panel: DataFrame) -> DataFrame:
    """Adds daily_return: close over the last known close before, less 1."""
    held = panel.withColumn("__held", F.last("close", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("__held").over(by_date())
    return held.withColumn("daily_return", F.col("__held") / F.nullif(before, F.lit(0.0)) - 1).drop("__held")


def rebalance_dates(values: DataFrame, rebalance: str = "weekly") -> DataFrame:
    """Every first, fifth or 21st distinct date: trade_date and its number i. Dates are few, so one window holds them."""
    days = values.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    return days.where(F.col("i") % EVERY.get(rebalance, 1) == 0)


def build_weights(values: DataFrame, strategy: str = "long_short", config: PortfolioConfig | None = None) -> DataFrame:
    """trade_date, symbol, weight on rebalance dates. values: symbol, trade_date, factor_value.

    Equal values go by symbol. An unknown strategy has no weights.
    """
    c = config or PortfolioConfig()
    held = values.join(rebalance_dates(values, c.rebalance).select("trade_date"), "trade_date").where("factor_value is not null")
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("factor_value"), "symbol"))
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    held = held.withColumns({"place": place, "n": n})
    size = lambda q: F.greatest(F.floor(F.col("n") * F.lit(float(q))), F.lit(1))
    top_n, bottom_n = size(c.top_quantile), size(c.bottom_quantile)
    is_top, is_bottom = F.col("place") <= top_n, F.col("place") > F.col("n") - bottom_n
    long, short = (F.least(1.0 / k, F.lit(c.max_single_weight)) for k in (top_n, bottom_n))
    weight: dict[str, Column] = {
        "top_quantile": F.when(is_top, long), "bottom_quantile": F.when(is_bottom, short),
        "long_short": F.when(is_bottom, -short).when(is_top, long), "equal_weight": 1.0 / F.col("n"),
    }
    w = weight.get(strategy, F.lit(None).cast("double"))
    out = held.select("trade_date", "symbol", w.alias("weight")).where("weight is not null")
    if c.lag_weights:
        days = values.select("trade_date").distinct()
        following = days.withColumn("next", F.lead("trade_date").over(Window.orderBy("trade_date")))
        out = out.join(following, "trade_date").where("next is not null").select(F.col("next").alias("trade_date"), "symbol", "weight")
    return out


def gross_returns(values: DataFrame, weights: DataFrame) -> DataFrame:
    """trade_date, gross: sum of weight times daily_return; a day without any return is 0. values has daily_return."""
    both = values.select("symbol", "trade_date", "daily_return").join(weights, ["trade_date", "symbol"])
    return both.groupBy("trade_date").agg(F.coalesce(F.sum(F.col("daily_return") * F.col("weight")), F.lit(0.0)).alias("gross"))


def costs(weights: DataFrame, config: PortfolioConfig | None = None) -> DataFrame:
    """trade_date, cost: gross weight times the cost of a trade."""
    c = config or PortfolioConfig()
    rate = (c.transaction_cost_bps + c.slippage_bps) / 10_000.0
    return weights.groupBy("trade_date").agg((F.sum(F.abs("weight")) * F.lit(rate)).alias("cost"))


def portfolio_turnover(weights: DataFrame) -> DataFrame:
    """One row, turnover: mean over neighbouring rebalance dates of half the summed absolute weight changes.

    Each weight counts for its own date and, negated, for the next: one union and aggregation replace an outer join.
    """
    days = weights.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")))
    w = weights.join(days, "trade_date").select("i", "symbol", "weight")
    shifted = w.select(F.col("i") + 1, "symbol", -F.col("weight"))
    moves = w.unionAll(shifted).groupBy("i", "symbol").agg(F.sum("weight").alias("change"))
    by_day = moves.groupBy("i").agg((F.sum(F.abs("change")) / 2).alias("moved"))
    last = days.agg(F.max("i").alias("last"))
    inner = by_day.join(last, (F.col("i") > 1) & (F.col("i") <= F.col("last")))
    return inner.agg(F.coalesce(F.avg("moved"), F.lit(0.0)).alias("turnover"))


def daily_returns(values: DataFrame, weights: DataFrame, config: PortfolioConfig | None = None) -> DataFrame:
    """trade_date, gross, cost, net, cumulative, drawdown."""
    d = gross_returns(values, weights).join(costs(weights, config), "trade_date", "left")
    d = d.withColumn("cost", F.coalesce("cost", F.lit(0.0))).withColumn("net", F.col("gross") - F.col("cost"))
    run = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("cumulative", F.product(1 + F.col("net")).over(run) - 1)
    return d.withColumn("drawdown", F.col("cumulative") - F.max("cumulative").over(run))


def summary(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """One row; an empty portfolio is all zeros."""
    n = F.count(F.lit(1))
    total = F.max_by("cumulative", "trade_date")
    grown = F.when(1 + total >= 0, F.pow(1 + total, F.lit(252.0) / F.nullif(n, F.lit(0))) - 1)
    s = returns.agg(
        n.alias("n_days"), grown.alias("annual_return"), (F.stddev_samp("net") * F.sqrt(F.lit(252.0))).alias("annual_volatility"),
        F.min("drawdown").alias("max_drawdown"), F.sum("cost").alias("total_cost"), total.alias("return_after_cost"),
        (F.product(1 + F.col("gross")) - 1).alias("gross_return"),
    )
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    s = s.withColumns({"sharpe_ratio": over("annual_return", F.col("annual_volatility")), "calmar_ratio": over("annual_return", F.abs("max_drawdown")), "return_before_cost": F.col("return_after_cost")})
    zero = [c for c in s.columns if c not in ("n_days", "annual_volatility")]
    s = s.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})
    return s.join(portfolio_turnover(weights), F.lit(True))


def run(values: DataFrame, panel: DataFrame, strategy: str = "long_short", config: PortfolioConfig | None = None) -> DataFrame:
    """The summary of one strategy. values: symbol, trade_date, factor_value; panel: symbol, trade_date, close."""
    returns = with_daily_return(panel.select("symbol", "trade_date", "close")).select("symbol", "trade_date", "daily_return")
    merged = values.join(returns, ["symbol", "trade_date"])
    weights = build_weights(merged, strategy, config)
    return summary(daily_returns(merged, weights, config), weights)
