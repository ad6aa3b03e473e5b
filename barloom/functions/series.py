"""The functions of the expression language as Column builders.

All are NULL-safe and never produce NaN: a missing input, an undefined result (zero divisor, no variance, root of
a negative number by **) is NULL. None relies on ANSI mode being off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SYMBOL, DATE = "symbol", "trade_date"


def _by_symbol():
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def _last(n: int):
    return _by_symbol().rowsBetween(1 - n, 0)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def guarded_corr(x: Column, y: Column, agg: Callable[[Column], Column]) -> Column:
    """Pearson correlation of pairs with both values; NULL without variance. agg binds an aggregate to its frame."""
    xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return agg(F.covar_samp(xm, ym)) / F.nullif(agg(F.stddev_samp(xm)) * agg(F.stddev_samp(ym)), F.lit(0.0))


def delay(x: Column, n: int) -> Column:
    return F.lag(x, n).over(_by_symbol()) if n else x


def delta(x: Column, n: int = 1) -> Column:
    return x - delay(x, n)


def ret(x: Column, n: int = 1) -> Column:
    before = delay(x, n)
    return ratio(x - before, before)


def ts_mean(x: Column, n: int) -> Column:
    return F.avg(x).over(_last(n))


def ts_sum(x: Column, n: int) -> Column:
    return F.sum(x).over(_last(n))


def ts_std(x: Column, n: int) -> Column:
    return F.stddev_samp(x).over(_last(n))


def ts_min(x: Column, n: int) -> Column:
    return F.min(x).over(_last(n))


def ts_max(x: Column, n: int) -> Column:
    return F.max(x).over(_last(n))


def ts_rank(x: Column, n: int) -> Column:
    """Share of the window's values below the current one, ties at their average place."""
    values = F.collect_list(x).over(_last(n))
    below, same = (F.size(F.filter(values, f)) for f in (lambda v: v < x, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (same + 1) / F.lit(2.0)) / F.size(values))


def corr(x: Column, y: Column, n: int) -> Column:
    return guarded_corr(x, y, lambda a: a.over(_last(n)))


def cov(x: Column, y: Column, n: int) -> Column:
    xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_samp(xm, ym).over(_last(n))


def average_rank(x: Column, *scope: str) -> Column:
    """Rank of non-null values from 1, ties at their average place. Both windows share one partitioning and one sort: the first of
    the ties by rank, the last by the count of all rows up to them."""
    w = Window.partitionBy(*scope).orderBy(x.asc_nulls_last())
    last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + last) / F.lit(2.0))


def rank(x: Column, scope: str) -> Column:
    return average_rank(x, scope) / F.nullif(F.count(x).over(Window.partitionBy(scope)), F.lit(0))


def zscore(x: Column, scope: str) -> Column:
    w = Window.partitionBy(scope)
    return standard(x, F.avg(x).over(w), F.stddev_samp(x).over(w))


def standard(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd.isNull() | (sd == 0), x * 0.0).otherwise((x - mean) / F.nullif(sd, F.lit(0.0)))


def winsorize(x: Column, k: float, scope: str) -> Column:
    w = Window.partitionBy(scope)
    return held(x, F.avg(x).over(w), F.stddev_samp(x).over(w), k)


def held(x: Column, mean: Column, sd: Column, k: float) -> Column:
    """x, held within k spreads of the mean."""
    return F.when(x.isNull() | sd.isNull() | (sd == 0), x).otherwise(F.least(F.greatest(x, mean - k * sd), mean + k * sd))


def log1p(x: Column) -> Column:
    """Signed: of the absolute value, with the sign of x."""
    return F.log1p(F.abs(x)) * F.signum(x)


def sqrt(x: Column) -> Column:
    """Signed, as log1p."""
    return F.sqrt(F.abs(x)) * F.signum(x)


def _both(a: Column, b: Column, c: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), c)


def least(a: Column, b: Column) -> Column:
    return _both(a, b, F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return _both(a, b, F.greatest(a, b))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def power(a: Column, b: Column) -> Column:
    p = F.pow(a, b)
    return F.when(~F.isnan(p), p)


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: F.coalesce(a > b, F.lit(False)),
    "<": lambda a, b: F.coalesce(a < b, F.lit(False)),
    ">=": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "<=": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "==": lambda a, b: F.coalesce(a == b, F.lit(False)),
    "!=": lambda a, b: F.coalesce(a != b, F.lit(True)),
}
