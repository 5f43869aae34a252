"""Sorts, ranks and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import missing as m
from ..sources.store import bounded, materialized


def numbered(df: DataFrame, order: list, to: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order of these columns, which must be total. Rows are range-partitioned and
    counted in each partition, so no task needs all of them; only the partitions' sizes are gathered."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialized(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    before, pairs = 0, []
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(before)]
        before += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    start = F.create_map(*pairs)[F.col("_part")] if pairs else F.lit(0)
    return dealt.withColumn(to, (own + start).cast("int" if before < 2**31 else "long")).drop("_part")


def sorted_values(df: DataFrame, col: str, descending: bool = False, keep_missing: bool = True) -> DataFrame:
    """Rows by value with missing ones last, or left out."""
    out = df.withColumn("_v", m.value(col))
    out = out if keep_missing else out.where("_v is not null")
    return out.orderBy(F.desc_nulls_last("_v") if descending else F.asc_nulls_last("_v")).drop("_v")


def sort_places(df: DataFrame, col: str, key: str, descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """Each row's place in the stable sort by value, then key: missing values come first ascending, last descending."""
    v = m.value(col)
    order = F.desc_nulls_last(v) if descending else F.asc_nulls_first(v)
    if not by:
        return numbered(df, [order, F.asc(key)])
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, F.asc(key))))


def top_by_group(df: DataFrame, by: list[str], col: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(m.value(col)), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def signal_order(w: DataFrame, h: DataFrame) -> DataFrame:
    """Signals k by total contribution, sum over i of W times sum over j of H: (k, total, place)."""
    total = w.groupBy("k").agg(F.sum("w").alias("a")).join(h.groupBy("k").agg(F.sum("h").alias("b")), "k").select("k", (F.col("a") * F.col("b")).alias("total"))
    return total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "k")))


def important(df: DataFrame, name: str, rank: str, label: str | None = None, wanted: list[str] | None = None, limit: int = 30) -> DataFrame:
    """The names to show: those wanted, then the best of each label, then by rank, limit in all."""
    first = F.col(name).isin(wanted) if wanted else F.lit(False)
    if label:
        best = df.groupBy(label).agg(F.min(F.struct(rank, name)).alias("_best"))
        df = df.join(bounded(best), label, "left")
    tier = F.when(first, 0).when(F.col("_best") == F.struct(rank, name) if label else F.lit(False), 1).otherwise(2)
    top = df.withColumn("_tier", tier).orderBy("_tier", rank, name).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_tier", rank, name))).drop("_tier", "_best")  # limit rows at most


def signal_members(x: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """x (name, k, v): each signal's members of at least cutoff of its largest, with their place in it."""
    top = x.groupBy("k").agg(F.max("v").alias("_top"))
    share = x.join(top, "k").withColumn("share", F.try_divide("v", "_top")).where(F.col("share") >= cutoff)
    return share.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("share"), "name"))).select("k", "place", "name", "share")


def strongest_signal(x: DataFrame) -> DataFrame:
    """x (name, k, v): each name's signal of largest value, ties to the smaller k."""
    return x.groupBy("name").agg(F.max(F.struct(F.col("v"), (-F.col("k")).alias("nk"))).alias("_m")).select("name", (-F.col("_m.nk")).alias("k"), F.col("_m.v").alias("v"))


def grid_thinned(df: DataFrame, lon: str, lat: str, key: str, bins: int) -> DataFrame:
    """In each cell of a bins x bins grid the point farthest from the centre of all, and the points at the extremes."""
    s = df.agg(F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.min(lat).alias("y0"), F.max(lat).alias("y1"), F.avg(lon).alias("cx"), F.avg(lat).alias("cy"))
    at = df.crossJoin(F.broadcast(s))
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / (F.col(b) - F.col(a)) * bins), F.lit(bins - 1))
    far = F.pow(F.col(lon) - F.col("cx"), 2) + F.pow(F.col(lat) - F.col("cy"), 2)
    at = at.withColumns({"_i": cell(lon, "x0", "x1"), "_j": cell(lat, "y0", "y1"), "_far": far})
    first = F.row_number().over(Window.partitionBy("_i", "_j").orderBy(F.desc("_far"), key)) == 1
    edge = (F.col(lon) == F.col("x0")) | (F.col(lon) == F.col("x1")) | (F.col(lat) == F.col("y0")) | (F.col(lat) == F.col("y1"))
    return at.withColumn("_keep", first | edge).where("_keep").select(*df.columns)


def grid_reduced(df: DataFrame, lon: str, lat: str, skip: int, digits: int = 6) -> DataFrame:
    """Points whose rounded coordinates are both among every skip-th distinct one."""
    def every(c):
        u = df.select(F.round(c, digits).alias("_u")).distinct()
        return numbered(u, [F.asc("_u")], "_r").where((F.col("_r") - 1) % skip == 0).select("_u")

    keep = df.join(every(lon), F.round(lon, digits) == F.col("_u"), "left_semi")
    return keep.join(every(lat), F.round(lat, digits) == F.col("_u"), "left_semi")


def by_size(df: DataFrame, label: str, to: str = "cluster") -> DataFrame:
    """Labels renumbered from 1 by falling number of rows, ties by the old label."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    new = sizes.withColumn(to, F.row_number().over(Window.orderBy(F.desc("_n"), label))).select(label, to)
    return df.join(new, label)
