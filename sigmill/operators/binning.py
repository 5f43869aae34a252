"""Bins: indices, mid-points, gridded means, time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing as m
from .transform import with_stats


def bin_index(df: DataFrame, col: str, bins: int | None = None, step: float | None = None, low: float | None = None, high: float | None = None, granulate: bool = True, reverse: bool = False, to: str = "bin") -> DataFrame:
    """ceil((v - low) / (high - low) * bins).

    With a step the bins follow from it, after low and high were moved outwards to whole steps (granulate). One value
    at place 0 moves to bin 1; with more than one, every bin moves up by one.
    """
    v = m.value(col)
    lo, hi = F.lit(low).cast("double") if low is not None else F.min(v), F.lit(high).cast("double") if high is not None else F.max(v)
    out = with_stats(df, {"_lo": lo, "_hi": hi, "_n": F.count(v)})
    if step is not None:
        if granulate:
            out = out.withColumns({"_lo": F.floor(F.col("_lo") / step) * step, "_hi": F.ceil(F.col("_hi") / step) * step})
        count: Column = F.ceil((F.col("_hi") - F.col("_lo")) / step)
    else:
        count = F.lit(bins) if bins is not None else F.col("_n")
    out = out.withColumn("_bins", count.cast("long")).withColumn("_b", F.ceil((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")).cast("long"))
    out = with_stats(out, {"_zero": F.count_if(F.col("_b") == 0)})
    b = F.when(F.col("_zero") > 1, F.col("_b") + 1).when(F.col("_b") == 0, 1).otherwise(F.col("_b"))
    top = F.col("_bins")
    b = top + 1 - b if reverse else b
    return out.withColumn(to, b.cast("int")).drop("_lo", "_hi", "_n", "_bins", "_b", "_zero")


def bin_centres(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, centre) of equal bins over the column's range; of dates the day that the centre falls on."""
    if dict(df.dtypes)[col] == "date":
        days = bin_centres(df.select(F.unix_date(col).alias(col)), col, bins)
        return days.withColumn("centre", F.date_from_unix_date(F.floor("centre").cast("int")))
    ends = df.agg(F.min(m.value(col)).alias("lo"), F.max(m.value(col)).alias("hi"))
    return ends.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * (2 * i + 1) / (2.0 * bins)))).select((F.col("pos") + 1).alias("bin"), F.col("col").alias("centre"))


def grid_mean(df: DataFrame, x: str, y: str, z: str, xbins: int, ybins: int, every_cell: bool = True) -> DataFrame:
    """Mean and count of z in each (x bin, y bin); cells without a value are there, missing."""
    at = bin_index(bin_index(df, x, xbins, to="ix"), y, ybins, to="iy")
    found = at.groupBy("ix", "iy").agg(m.mean(z).alias("mean"), m.count(z).alias("n"))
    if not every_cell:
        return found.where("n > 0")
    spark = df.sparkSession
    cells = spark.range(xbins * ybins).select((F.col("id") % xbins + 1).cast("int").alias("ix"), (F.floor(F.col("id") / xbins) + 1).cast("int").alias("iy"))
    return cells.join(found, ["ix", "iy"], "left").select("ix", "iy", "mean", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def time_bin(df: DataFrame, col: str, step: str, to: str = "bin") -> DataFrame:
    """Whole steps ('day', 'week', 'month', ..) from the first one, counted from 1."""
    at = F.date_trunc(step, F.col(col))
    out = with_stats(df, {"_first": F.min(at)})
    months = {"month": 1, "quarter": 3, "year": 12}
    if step in months:
        n = F.months_between(at, F.col("_first")) / months[step]
    else:
        n = (F.unix_timestamp(at) - F.unix_timestamp(F.col("_first"))) / {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[step]
    return out.withColumn(to, (F.round(n) + 1).cast("int")).drop("_first")
