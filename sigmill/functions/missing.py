"""Missing values: a float NaN is a NULL inside the engine, and every reduction skips it.

All functions take and give Columns, so they compile into the caller's aggregate or projection. A reduction over
nothing is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def value(c: Column | str) -> Column:
    """The column as double with NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def parsed(c: Column | str) -> Column:
    """Text as double: '', 'NaN' and anything that isn't a number are NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return value(F.trim(c.cast("string")).try_cast("double"))


def finite(c: Column | str) -> Column:
    v = value(c)
    return F.when(F.abs(v) != F.lit(float("inf")), v)


def filled(c: Column | str, by: float = 1.0) -> Column:
    return F.coalesce(value(c), F.lit(float(by)))


def is_missing(c: Column | str, text: bool = False) -> Column:
    """NULL, NaN or, for text, empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.length(c) == 0) if text else value(c).isNull()


def sum_(c):
    return F.sum(value(c))


def mean(c):
    return F.avg(value(c))


def largest(c):
    return F.max(value(c))


def smallest(c):
    return F.min(value(c))


def count(c):
    return F.count(value(c))


def variance(c):
    """Sample variance; NULL below two values."""
    return F.when(count(c) > 1, F.var_samp(value(c)))


def deviation(c):
    return F.when(count(c) > 1, F.stddev_samp(value(c)))


def skewness(c):
    """Population skewness."""
    return F.skewness(value(c))


def squares(c):
    return F.sum(value(c) * value(c))


def norm(c):
    return F.sqrt(squares(c))


def _pair(x, y):
    x, y = value(x), value(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def distance(x, y):
    """Euclidean distance over rows where both are there."""
    return F.sqrt(F.sum(F.pow(value(x) - value(y), 2)))


def rmse(x, y):
    return F.sqrt(F.avg(F.pow(value(x) - value(y), 2)))


def l1(x, y):
    return F.sum(F.abs(value(x) - value(y)))


def covariance(x, y):
    x, y = _pair(x, y)
    return F.when(F.count(x) > 1, F.covar_samp(x, y))


def correlation(x, y):
    x, y = _pair(x, y)
    return F.when(F.count(x) > 1, F.corr(x, y))


def r2(x, y):
    """Squared correlation over rows where both are finite."""
    return F.pow(correlation(finite(x), finite(y)), 2)


def explained(truth, estimate):
    """1 - SSE / SST over rows where both are there."""
    t, e = _pair(truth, estimate)
    return 1 - F.try_divide(F.sum(F.pow(t - e, 2)), F.var_pop(t) * F.count(t))
