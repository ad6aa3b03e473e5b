"""Scores of factor values against forward returns, for any number of factors in one job.

Values come in long form: factor_id, symbol, trade_date, factor_value (and forward_return, computed on the panel
itself by lead(), so that no join is needed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import average_rank, guarded_corr
from barloom.panel import by_date

LEAST_PAIRS = 5
GROUP = ["factor_id", "trade_date"]
#: What tied() takes as equal unless told otherwise; metrics rank values as they are unless they are given digits.
TIE_DIGITS = 9


def with_forward_return(panel: DataFrame, period: int = 1, fill: bool = True) -> DataFrame:
    """Adds forward_return: close `period` bars later over close, less 1. fill carries the last close over gaps."""
    if fill:
        held = F.last("close", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
        panel = panel.withColumn("__close", held)
    else:
        panel = panel.withColumn("__close", F.col("close"))
    later = F.lead("__close", period).over(by_date())
    return panel.withColumn("forward_return", later / F.nullif(F.col("__close"), F.lit(0.0)) - 1).drop("__close")


def tied(x: Column, digits: int | None = TIE_DIGITS) -> Column:
    """x to its leading digits, whatever its size, for ranking (None: x itself): what values differ in beyond may be the order of a sum. Zero, infinite and
    extreme values stay."""
    if digits is None:
        return x
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(F.abs(x).between(1e-290, 1e290), F.rint(x * scale) / scale).otherwise(x)


def daily_ic(values: DataFrame, digits: int | None = None) -> DataFrame:
    """factor_id, trade_date, ic, rankic, n: Pearson and Spearman correlation by date with LEAST_PAIRS pairs or more.
    Ranks are those of tied(factor_value, digits); ic takes the values as they are."""
    pairs = values.where("factor_value is not null and forward_return is not null")
    ranked = pairs.withColumns({"__x": average_rank(tied(F.col("factor_value"), digits), *GROUP), "__y": average_rank(F.col("forward_return"), *GROUP)})
    plain = lambda c: c
    return ranked.groupBy(*GROUP).agg(
        guarded_corr(F.col("factor_value"), F.col("forward_return"), plain).alias("ic"),
        guarded_corr(F.col("__x"), F.col("__y"), plain).alias("rankic"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= LEAST_PAIRS)


def _ratio(mean: Column, sd: Column) -> Column:
    return F.coalesce(mean / F.nullif(sd, F.lit(0.0)), F.lit(0.0))


def ic_summary(daily: DataFrame, annualization: float = 252.0) -> DataFrame:
    """By factor. Dates with an undefined IC count as dates, also in the share of positive ones."""
    return _summary(daily, annualization, F.lit(True))


def _summary(daily: DataFrame, annualization: float, is_date: Column, *others: Column) -> DataFrame:
    """ic_summary of the rows that stand for a date, and others, aggregates of all rows. On other rows ic and rankic are null."""
    n = F.count_if(is_date)
    spread = lambda c: F.when(n > 1, F.stddev_samp(c)).otherwise(F.lit(0.0))
    root = F.sqrt(F.lit(float(annualization)))
    out = daily.groupBy("factor_id").agg(
        F.avg("ic").alias("ic_mean"), spread("ic").alias("ic_std"), _ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg("rankic").alias("rankic_mean"), spread("rankic").alias("rankic_std"), _ratio(F.avg("rankic"), F.stddev_samp("rankic")).alias("rankicir"),
        F.nullif(n, F.lit(0)).alias("n_valid_dates"), (F.count_if(F.col("ic") > 0) / F.nullif(n, F.lit(0))).alias("positive_ic_ratio"), *others,
    )
    return out.withColumns({"annualized_icir": F.col("icir") * root, "annualized_rank_icir": F.col("rankicir") * root})


def coverage(values: DataFrame) -> DataFrame:
    return values.groupBy("factor_id").agg(F.avg(F.col("factor_value").isNotNull().cast("double")).alias("coverage"))


def rank_turnover(values: DataFrame, digits: int | None = None, unique: bool = False) -> DataFrame:
    """By factor: mean over symbols of the mean absolute change of the symbol's percentage rank between one date and
    the next. A date counts if any symbol has a value; a change needs a value on both. Ranks are those of tied values.

    unique: no factor has two values of a symbol on one date; otherwise such values are averaged first, by one more sort. Rows are sorted by group
    after they were dealt, never hashed before, so that a task's memory depends on the rows that it is dealt.
    """
    held = values.where("factor_value is not null").select(*GROUP, "symbol", F.col("factor_value").alias("v"))
    days = held.select(*GROUP).distinct().withColumn("i", F.row_number().over(Window.partitionBy("factor_id").orderBy("trade_date")))
    if not unique:
        one = Window.partitionBy(*GROUP, "symbol").orderBy("v")
        all_of_it = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        mean = held.repartition(*GROUP).withColumns({"__mean": F.avg("v").over(all_of_it), "__place": F.row_number().over(one)})
        held = mean.where("__place = 1").select(*GROUP, "symbol", F.col("__mean").alias("v"))
    ranked = held.withColumn("r", average_rank(tied(F.col("v"), digits), *GROUP) / F.count(F.lit(1)).over(Window.partitionBy(*GROUP)))
    own = Window.partitionBy("factor_id", "symbol").orderBy("i")
    change = F.when(F.lag("i").over(own) == F.col("i") - 1, F.abs(F.col("r") - F.lag("r").over(own)))
    # a row for each factor and date
    moved = ranked.select(*GROUP, "symbol", "r").join(F.broadcast(days), GROUP).select("factor_id", "symbol", change.alias("change"))
    return moved.groupBy("factor_id", "symbol").agg(F.avg("change").alias("change")).groupBy("factor_id").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("turnover"))


def _turnover_and_ic(values: DataFrame, annualization: float, digits: int | None) -> DataFrame:
    """By factor, rank_turnover and ic_summary of daily_ic in one pass, for values without two of a symbol on one date: they are dealt by group and sorted by
    value once, then dealt by symbol. A date's correlations travel on its first row."""
    held = values.where("factor_value is not null").select(*GROUP, "symbol", "factor_value", "forward_return")
    days = held.select(*GROUP).distinct().withColumn("i", F.row_number().over(Window.partitionBy("factor_id").orderBy("trade_date")))
    pair, group = F.col("forward_return").isNotNull(), Window.partitionBy(*GROUP)
    rows = held.withColumn("__x", tied(F.col("factor_value"), digits)).withColumn("__y", average_rank(F.col("forward_return"), *GROUP))
    by_x = group.orderBy("__x")
    up_to = by_x.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "__first": F.rank().over(by_x), "__last": F.count(F.lit(1)).over(up_to), "__pairs": F.count_if(pair).over(up_to), "__row": F.row_number().over(by_x),
    })
    # of the ties of a value, how many are in pairs
    rows = rows.withColumn("__tied", F.count_if(pair).over(Window.partitionBy(*GROUP, "__x")))
    rank_x = F.when(pair, F.col("__pairs") - (F.col("__tied") - 1) / F.lit(2.0))
    bound = lambda a: a.over(group)
    paired = F.when(pair, F.col("factor_value"))
    rows = rows.withColumn("__rx", rank_x).withColumns({
        "r": (F.col("__first") + F.col("__last")) / F.lit(2.0) / F.count(F.lit(1)).over(group), "n": F.count_if(pair).over(group),
        "ic": guarded_corr(paired, F.col("forward_return"), bound), "rankic": guarded_corr(F.col("__rx"), F.col("__y"), bound),
    })
    told = (F.col("__row") == 1) & (F.col("n") >= LEAST_PAIRS)
    rows = rows.select(*GROUP, "symbol", "r", *[F.when(told, F.col(c)).alias(c) for c in ("ic", "rankic", "n")])
    own = Window.partitionBy("factor_id", "symbol").orderBy("i")
    change = F.when(F.lag("i").over(own) == F.col("i") - 1, F.abs(F.col("r") - F.lag("r").over(own)))
    # a row for each factor and date; rows without a date have no next one
    moved = rows.join(F.broadcast(days), GROUP, "left").withColumns({"change": change, "__end": F.lead("r").over(own).isNull()})
    moved = moved.withColumn("__k", F.count("change").over(Window.partitionBy("factor_id", "symbol")))
    symbols = F.count_if(F.col("__end") & (F.col("__k") > 0))
    turnover = F.coalesce(F.sum(F.col("change") / F.nullif(F.col("__k"), F.lit(0))) / F.nullif(symbols, F.lit(0)), F.lit(0.0))
    return _summary(moved, annualization, F.col("n").isNotNull(), turnover.alias("turnover"))


def all_metrics(values: DataFrame, annualization: float = 252.0, digits: int | None = None, unique: bool = False) -> DataFrame:
    """One row for each factor with any valid date; the others are all zeros. Ranks are those of tied values; unique as in rank_turnover.

    Several aggregations read the values: the caller writes or caches them first (and frees them) where they are dear to compute.
    """
    if unique:
        scores = _turnover_and_ic(values, annualization, digits)
        base = coverage(values).join(scores, "factor_id", "left")
    else:
        base = coverage(values).join(rank_turnover(values, digits), "factor_id", "left").join(ic_summary(daily_ic(values, digits), annualization), "factor_id", "left")
    none = F.col("n_valid_dates").isNull()
    cols = [c for c in base.columns if c not in ("factor_id", "n_valid_dates")]
    zeros = {c: F.when(none, F.lit(0.0)).otherwise(F.col(c)) for c in cols}
    return base.withColumns({**zeros, "n_valid_dates": F.coalesce("n_valid_dates", F.lit(0).cast("long"))}).withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
