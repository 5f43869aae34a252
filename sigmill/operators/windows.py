"""Ordered operators: cumulative sums, moving means, slopes, data windows, shifts, patterns, peaks.

Every function takes the order column and optional series columns; without a series there is one ordered sequence,
which Spark handles in one task, so long tables should name their series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import missing as m


def _w(order: str, by: list[str] | None):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)


def cumulative_sum(df: DataFrame, col: str, order: str, by: list[str] | None = None, to: str = "cum") -> DataFrame:
    """Running sum with missing values as 0; missing where the series has no value at all."""
    some = F.count(m.value(col)).over(Window.partitionBy(*(by or [F.lit(0)])))
    total = F.sum(m.filled(col, 0.0)).over(_w(order, by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(to, F.when(some > 0, total))


def moving_mean(df: DataFrame, col: str, order: str, window: int = 3, by: list[str] | None = None, to: str = "mean") -> DataFrame:
    """Centred mean with cut-off ends; an even window reaches window/2 back and window/2 - 1 ahead."""
    back, ahead = (window // 2, window // 2) if window % 2 else (window // 2, window // 2 - 1)
    return df.withColumn(to, F.avg(m.value(col)).over(_w(order, by).rowsBetween(-back, ahead)))


def neighbourhood(df: DataFrame, col: str, order: str, radius: int = 1, reducer: Callable[[Column], Column] = F.avg, by: list[str] | None = None, to: str = "near") -> DataFrame:
    return df.withColumn(to, reducer(m.value(col)).over(_w(order, by).rowsBetween(-radius, radius)))


def neighbourhood_nd(cells: DataFrame, axes: list[str], radius: int = 1, reducer: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Cells (axes.., v) reduced over the box of the radius, by an equi-join on shifted axes; the shifts are (2r+1)^axes rows a cell."""
    shifted = cells
    for a in axes:
        shifted = shifted.withColumn(a, F.explode(F.sequence(F.col(a) - radius, F.col(a) + radius)))
    near = shifted.groupBy(*axes).agg(reducer(m.value("v")).alias("near"))
    return cells.join(near, axes)


def slopes(df: DataFrame, col: str, order: str, by: list[str] | None = None, to: str = "slope") -> DataFrame:
    """Central differences, one-sided at the ends."""
    w, v = _w(order, by), m.value(col)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    inside = F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()
    return df.withColumn(to, F.when(inside, (after - before) / 2).otherwise(F.coalesce(after - v, v - before)))


def step_range(df: DataFrame, col: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Least, largest and spread of successive differences."""
    d = df.withColumn("_d", m.value(col) - F.lag(m.value(col)).over(_w(order, by)))
    out = d.groupBy(*by) if by else d
    return out.agg(F.min("_d").alias("least"), F.max("_d").alias("largest"), (F.max("_d") - F.min("_d")).alias("spread"))


def data_window(df: DataFrame, order: str, first: Column, last: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """First and last place where the predicates hold, and the span between them."""
    last = first if last is None else last
    a, b = F.min(F.when(first, F.col(order))), F.max(F.when(last, F.col(order)))
    return (df.groupBy(*by) if by else df).agg(a.alias("first"), b.alias("last"), (b - a + 1).alias("span"))


def left_aligned(df: DataFrame, col: str, order: str, by: list[str]) -> DataFrame:
    """Each series from its first to its last positive value, with places counted from 1."""
    win = data_window(df, order, m.value(col) > 0, by=by).where("first is not null")
    return df.join(win, by).where((F.col(order) >= F.col("first")) & (F.col(order) <= F.col("last"))).select(*by, (F.col(order) - F.col("first") + 1).alias("place"), col)


def pattern_places(df: DataFrame, col: str, order: str, pattern: list, by: list[str] | None = None) -> DataFrame:
    """The first row at which the pattern begins, in each series."""
    w = _w(order, by)
    hit = F.lit(True)
    for i, x in enumerate(pattern):
        hit = hit & F.coalesce((F.lead(col, i).over(w) if i else F.col(col)) == F.lit(x), F.lit(False))
    found = df.withColumn("_hit", hit).where("_hit")
    return (found.groupBy(*by) if by else found).agg(F.min(order).alias("place"))


def zscore_signals(y: np.ndarray, lag: int = 30, threshold: float = 5.0, influence: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signals -1, 0, 1 and the filtered mean and deviation: each value is judged by the lag filtered ones up to the one before.

    The first lag values give the mean that the lag-th value is judged by; the last value isn't judged. A lag over the
    length is the length.
    """
    y = np.asarray(y, float)
    n = len(y)
    lag = min(lag, n)
    signals, mean, dev = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    if lag < 2:
        return signals, mean, dev
    kept = y.copy()
    mean[lag - 2], dev[lag - 2] = y[:lag].mean(), y[:lag].std(ddof=1)
    for i in range(lag - 1, n - 1):
        if abs(y[i] - mean[i - 1]) > threshold * dev[i - 1]:
            signals[i] = 1 if y[i] > mean[i - 1] else -1
            kept[i] = influence * y[i] + (1 - influence) * kept[i - 1]
        own = kept[i - lag + 1 : i + 1]
        mean[i], dev[i] = own.mean(), own.std(ddof=1)
    return signals, mean, dev


def peaks(df: DataFrame, col: str, order: str, by: list[str], lag: int = 30, threshold: float = 5.0, influence: float = 0.0) -> DataFrame:
    """signal, filtered_mean and filtered_deviation of each row; a recurrence, so one task a series."""
    keys = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s, mean, dev = zscore_signals(pdf[col].fillna(0).to_numpy(), lag, threshold, influence)
        return pdf[[*by, order, col]].assign(signal=s, filtered_mean=mean, filtered_deviation=dev)

    schema = ", ".join(f"{c} {keys[c]}" for c in [*by, order, col]) + ", signal long, filtered_mean double, filtered_deviation double"
    return df.select(*by, order, col).groupBy(*by).applyInPandas(one, schema)


def first_jump(df: DataFrame, col: str, order: str, by: list[str], lag: int = 30, threshold: float = 5.0, influence: float = 0.0) -> DataFrame:
    """The place of the first positive value from the first rise of the signal from 0 to 1 on, or of any if the signal
    doesn't rise; none for series that sum to 0. Missing values count as 0."""
    found = peaks(df.withColumn(col, m.filled(col, 0.0)), col, order, by, lag, threshold, influence)
    w = Window.partitionBy(*by).orderBy(order)
    rise = F.when((F.col("signal") == 0) & (F.lead("signal").over(w) == 1), F.col(order))
    found = found.withColumn("_rise", F.min(rise).over(Window.partitionBy(*by)))
    after = F.when((F.col(col) > 0) & (F.col("_rise").isNull() | (F.col(order) >= F.col("_rise"))), F.col(order))
    out = found.groupBy(*by).agg(F.min(after).alias("place"), F.sum(col).alias("_t")).where("_t <> 0 and place is not null")
    return out.drop("_t")
