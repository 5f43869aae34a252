"""Aggregations: column statistics, value counts, histograms, contingency tables, correlation matrices, signal shares."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing as m
from ..sources.store import bounded


def column_statistics(df: DataFrame, cols: list[str], log: bool = False) -> DataFrame:
    """A row a column: least, largest, deviation, skewness and count of its finite values, in one pass."""
    def v(c):
        x = m.finite(c)
        return F.when(x > 0, F.log10(F.when(x > 0, x))) if log else x

    one = df.agg(*[f(v(c)).alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp), ("sk", F.skewness), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("largest"), F.coalesce(F.col(f"sd_{c}"), F.lit(0.0)).alias("deviation"), F.coalesce(F.nanvl(F.col(f"sk_{c}"), F.lit(0.0)), F.lit(0.0)).alias("skewness"), F.col(f"n_{c}").alias("n")) for c in cols])
    return one.select(F.inline(rows))


def value_counts(df: DataFrame, col: str, cutoff: int = 0) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cutoff)


def histogram(df: DataFrame, col: str, low: float, step: float, bins: int, by: list[str] | None = None, closed: str = "left", proportion: bool = False) -> DataFrame:
    """Counts in fixed-width bins; the last bin also takes its far edge (the first its near edge if closed right)."""
    at = (m.value(col) - low) / step
    b = F.floor(at) if closed == "left" else F.ceil(at) - 1
    b = F.when(at == (bins if closed == "left" else 0), bins - 1 if closed == "left" else 0).otherwise(b)
    by = by or []
    out = df.withColumn("bin", b.cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    if proportion:
        total = out.groupBy(*by).agg(F.sum("n").alias("_t")) if by else out.agg(F.sum("n").alias("_t"))
        out = (out.join(total, by) if by else out.crossJoin(F.broadcast(total))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    return out


def contingency(df: DataFrame, a: str, b: str, zeros: bool = True) -> DataFrame:
    """Counts of label pairs; zeros: pairs that never meet are there with 0 (both sides are lists of labels)."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return counts
    pairs = df.select(a).distinct().crossJoin(bounded(df.select(b).distinct()))
    return pairs.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contingency_chain(df: DataFrame, labels: list[str]) -> DataFrame:
    """Counts between each two neighbouring labelings: (step, source, target, n)."""
    parts = [contingency(df, a, b, zeros=False).select(F.lit(i).alias("step"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), "n") for i, (a, b) in enumerate(zip(labels, labels[1:]))]
    return fold(DataFrame.unionByName, parts)


def r2_matrix(df: DataFrame, xs: list[str], ys: list[str], normalize: str = "none") -> DataFrame:
    """(x, y, r2) for every pair, from one aggregate; normalize: by the largest in the 'row', 'col' or 'all'."""
    one = df.agg(*[m.r2(x, y).alias(f"{i}_{j}") for i, x in enumerate(xs) for j, y in enumerate(ys)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{i}_{j}").alias("r2")) for i, x in enumerate(xs) for j, y in enumerate(ys)])))
    if normalize == "none":
        return long
    from .transform import over_largest

    return over_largest(long, ["r2"], {"row": ["x"], "col": ["y"], "all": None}[normalize])


def missing_attributes(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(cluster, attribute) pairs without a single value."""
    counts = df.groupBy(cluster).agg(*[m.count(c).alias(c) for c in cols])
    return counts.select(cluster, F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n")) for c in cols]))).where("n = 0").select(cluster, "attribute")


def reconstruction(w: DataFrame, h: DataFrame) -> DataFrame:
    """(i, j, v): sum over k of W(i, k, w) * H(k, j, h)."""
    return w.join(h, "k").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("h")).alias("v"))


def signal_shares(w: DataFrame, h: DataFrame) -> DataFrame:
    """For each attribute j the sample variance of each signal's own reconstruction, over that of the whole, then over the row's largest."""
    parts = w.join(h, "k").withColumn("p", F.col("w") * F.col("h"))
    own = parts.groupBy("j", "k").agg(F.var_samp("p").alias("own"))
    whole = parts.groupBy("i", "j").agg(F.sum("p").alias("v")).groupBy("j").agg(F.var_samp("v").alias("whole"))
    from .transform import over_largest

    return over_largest(own.join(whole, "j").select("j", "k", F.try_divide("own", "whole").alias("share")), ["share"], ["j"])


def ensemble_ranges(runs: DataFrame) -> DataFrame:
    """Entrywise least, largest and sample variance of v(run, i, j) over the runs."""
    return runs.groupBy("i", "j").agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.var_samp("v").alias("variance"))


def compression_error(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """Mean and largest absolute error, rmse, r2 (1 - SSE/SST) and number of pairs."""
    d = m.value(truth) - m.value(estimate)
    return df.agg(F.avg(F.abs(d)).alias("mae"), m.rmse(truth, estimate).alias("rmse"), F.max(F.abs(d)).alias("largest"), m.explained(truth, estimate).alias("r2"), F.count(d).alias("n"))


def mixture_deltas(mixer: DataFrame, buckets: DataFrame, deltas: DataFrame) -> DataFrame:
    """(i, j, delta): bucket deltas weighted by mixer(i, k, w) * concentration(k, j, c); deltas: (k, j, d)."""
    x = mixer.join(buckets, "k").join(deltas, ["k", "j"]).withColumn("_w", F.col("w") * F.col("c"))
    return x.groupBy("i", "j").agg(F.try_divide(F.sum(F.col("_w") * F.col("d")), F.sum("_w")).alias("delta"))


def count_where(predicate: Column) -> Column:
    return F.count_if(predicate)
