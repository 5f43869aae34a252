"""Clustering of rows and of factor solutions: silhouettes without all pairs, k-means and mixtures with restarts,
row compression, one-to-one assignments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.store import bounded, materialized
from .order import by_size


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(df: DataFrame, vec: str, to: str = "unit") -> DataFrame:
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    return df.withColumn(to, v).withColumn(to, F.transform(to, lambda x: x / F.greatest(F.sqrt(dot(F.col(to), F.col(to))), F.lit(1e-30))))


def cosine_silhouettes(df: DataFrame, vec: str, label: str, key: str) -> DataFrame:
    """(key, label, silhouette) exactly, in one join of rows with clusters: the distances of a row to a cluster sum to
    n - u . S with S the sum of the cluster's unit vectors. A row alone in its cluster has 0."""
    rows = unit(df.select(key, label, vec), vec)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = rows.groupBy(F.col(label).alias("c")).agg(Summarizer.sum(array_to_vector("unit")).alias("s"), F.count(F.lit(1)).alias("n"))  # one vector a cluster and task
    sums = parts.select("c", vector_to_array("s").alias("S"), "n")
    d = rows.crossJoin(bounded(sums)).select(key, label, "c", "n", (F.col("n") - dot(F.col("unit"), F.col("S"))).alias("d"))
    own = F.max(F.when((F.col("c") == F.col(label)) & (F.col("n") > 1), F.col("d") / (F.col("n") - 1)))
    other = F.min(F.when(F.col("c") != F.col(label), F.col("d") / F.col("n")))
    ab = d.groupBy(key, label).agg(own.alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(key, label, s.alias("silhouette"))


def medoids(df: DataFrame, vec: str, label: str, key: str) -> DataFrame:
    """(label, key): the member with the least sum of squared distances to its cluster, which is the one nearest the mean."""
    rows = df.select(key, label, F.transform(F.col(vec), lambda x: x.cast("double")).alias("v"))
    mean = cluster_means(rows, "v", label)
    far = F.aggregate(F.zip_with("v", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(mean, label).withColumn("_far", far).groupBy(label).agg(F.min(F.struct("_far", key)).alias("_m")).select(label, F.col("_m")[key].alias(key))


def cluster_means(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, mean, variance (population), n) as arrays."""
    parts = df.select(label, F.posexplode(vec)).groupBy(label, "pos").agg(F.avg(F.col("col").cast("double")).alias("a"), F.var_pop(F.col("col").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    ordered = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "v"))).alias("_x"), F.max("n").alias("n"))
    return ordered.select(label, F.transform("_x", lambda x: x["a"]).alias("mean"), F.transform("_x", lambda x: x["v"]).alias("variance"), "n")


def _vectors(df: DataFrame, vec: str, shift: float = 0.0) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double") + shift)))


def kmeans(df: DataFrame, vec: str, key: str, k: int, repeats: int = 3, cosine: bool = True, max_iter: int = 50, seed: int = 0) -> tuple[DataFrame, float, float]:
    """(rows with cluster by falling size, mean and worst cluster's silhouette) of the best of several starts."""
    from pyspark.ml.clustering import KMeans

    data = _vectors(df, vec, 1e-12 if cosine else 0.0)
    best = None
    for r in range(repeats):
        fit = KMeans(k=k, seed=seed + r, maxIter=max_iter, distanceMeasure="cosine" if cosine else "euclidean", featuresCol="_features", predictionCol="_p").fit(data)
        if best is None or fit.summary.trainingCost < best[0]:
            best = (fit.summary.trainingCost, fit)
    out = by_size(best[1].transform(data).drop("_features"), "_p").drop("_p")
    per = cosine_silhouettes(out, vec, "cluster", key).groupBy("cluster").agg(F.avg("silhouette").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    rows = sum(x["n"] for x in per)
    return out, sum(x["s"] * x["n"] for x in per) / rows, min(x["s"] for x in per)


def after_cliff(ks: list[int], worst: list[float]) -> int:
    """The k after the largest drop of the worst silhouette."""
    if len(ks) < 2:
        return ks[0]
    drops = [a - b for a, b in zip(worst, worst[1:])]
    return ks[int(np.argmax(drops)) + 1]


def kmeans_range(df: DataFrame, vec: str, key: str, ks: list[int], repeats: int = 3, **kw) -> tuple[int, DataFrame, list[float]]:
    found = [kmeans(df, vec, key, k, repeats, **kw) for k in ks]
    worst = [f[2] for f in found]
    k = after_cliff(ks, worst)
    return k, found[ks.index(k)][0], worst


def gaussian_mixture(df: DataFrame, vec: str, ks: list[int], repeats: int = 2, criterion: str = "bic", seed: int = 0) -> tuple[int, DataFrame, dict[int, float]]:
    """Best k by BIC or AIC, rows with cluster by falling size, and the criterion by k (full covariances)."""
    from pyspark.ml.clustering import GaussianMixture

    data = materialized(_vectors(df, vec))
    n, d = data.count(), len(data.select(vec).first()[0])
    scores, fits = {}, {}
    for k in ks:
        runs = [GaussianMixture(k=k, seed=seed + r, featuresCol="_features", predictionCol="_p", probabilityCol="_prob").fit(data) for r in range(repeats)]
        fit = max(runs, key=lambda f: f.summary.logLikelihood)
        p = mixture_parameters(k, d)
        scores[k] = p * (np.log(n) if criterion == "bic" else 2) - 2 * fit.summary.logLikelihood
        fits[k] = fit
    k = min(scores, key=scores.get)
    return k, by_size(fits[k].transform(data).drop("_features", "_prob"), "_p").drop("_p"), scores


def mixture_parameters(k: int, d: int, full: bool = True) -> int:
    return k - 1 + k * d + k * (d * (d + 1) // 2 if full else d)


@dataclass(frozen=True)
class Compressed:
    """labels: (key, cluster); groups: (cluster, mean, variance, n, medoid key); rows without any value are in cluster 0."""

    labels: DataFrame
    groups: DataFrame


def compress_rows(df: DataFrame, vec: str, key: str, ks: list[int], repeats: int = 2) -> Compressed:
    """Rows to the clusters of the k with the best mean silhouette (squared Euclidean). Missing values count as the mean of
    their place, 0 if it has no value; rows without any value are in cluster 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    there = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
    real = df.where(F.exists(vec, there))
    if real.where(F.exists(vec, lambda x: ~there(x))).limit(1).count():
        clean = F.transform(vec, lambda x: F.when(there(x), x.cast("double")))
        means = real.select(F.posexplode(clean).alias("pos", "v")).groupBy("pos").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("a"))
        means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]).alias("_means"))  # one value a place
        real = real.crossJoin(F.broadcast(means)).withColumn(vec, F.zip_with(clean, "_means", lambda x, a: F.coalesce(x, a))).drop("_means")
    data = materialized(_vectors(real, vec))
    best = None
    for k in ks:
        for r in range(repeats):
            out = KMeans(k=k, seed=r, featuresCol="_features", predictionCol="_p").fit(data).transform(data)
            several = out.select("_p").distinct().limit(2).count() > 1  # a start may end with all rows in one
            score = ClusteringEvaluator(featuresCol="_features", predictionCol="_p").evaluate(out) if several else -1.0
            if best is None or score > best[0]:
                best = (score, out)
    rows = by_size(best[1].drop("_features"), "_p").drop("_p")
    groups = cluster_means(rows, vec, "cluster").join(medoids(rows, vec, "cluster", key).withColumnRenamed(key, "medoid"), "cluster")
    labels = df.select(key).join(rows.select(key, "cluster"), key, "left").fillna(0, ["cluster"])
    return Compressed(labels, groups)


def decompress_rows(c: Compressed, key: str, noise: bool = False, seed: int = 0) -> DataFrame:
    """(key, v): each row as its cluster's mean, with Gaussian noise of the cluster's variance if asked."""
    out = c.labels.join(bounded(c.groups), "cluster", "left")
    v = F.col("mean")
    if noise:
        from ..functions.scalar import hashed_uniform

        def drawn(x, i):
            u, w = hashed_uniform(seed, key, i), hashed_uniform(seed + 1, key, i)
            return x + F.sqrt(F.element_at("variance", i + 1)) * F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * w)

        v = F.transform("mean", drawn)
    return out.select(key, v.alias("v"))


def greedy_assignment(x: np.ndarray) -> tuple[list[int], float] | None:
    """Row to column by repeatedly taking the largest entry left; None if entries run out (zeros don't count)."""
    a = np.abs(np.asarray(x, float))
    rows = [-1] * len(a)
    used: set[int] = set()
    for at in np.argsort(-a, axis=None, kind="stable"):
        i, j = divmod(int(at), a.shape[1])
        if rows[i] < 0 and j not in used and a[i, j] > 0:
            rows[i] = j
            used.add(j)
    if -1 in rows:
        return None
    return rows, float(sum(x[i][j] for i, j in enumerate(rows)))


def best_assignment(x: np.ndarray) -> tuple[list[int], float]:
    """The greedy assignment, improved by swaps of two rows until none helps; starts from the identity if greedy fails."""
    x = np.asarray(x, float)
    start = greedy_assignment(x)
    rows = start[0] if start else list(range(len(x)))
    better = True
    while better:
        better = False
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if x[i][rows[j]] + x[j][rows[i]] > x[i][rows[i]] + x[j][rows[j]] + 1e-12:
                    rows[i], rows[j] = rows[j], rows[i]
                    better = True
    return rows, float(sum(x[i][j] for i, j in enumerate(rows)))


def label_signal_means(x: DataFrame, labels: DataFrame) -> DataFrame:
    """x (name, k, v), labels (name, label): mean value of each label's members in each signal."""
    return x.join(labels, "name").groupBy("label", "k").agg(F.avg("v").alias("v"))


def signal_assignments(x: DataFrame, labels: DataFrame) -> dict:
    """label -> signal, one to one, by the mean matrix (labels x signals)."""
    got = label_signal_means(x, labels).collect()
    ls, ks = sorted({r["label"] for r in got}), sorted({r["k"] for r in got})
    a = np.zeros((len(ls), len(ks)))
    for r in got:
        a[ls.index(r["label"]), ks.index(r["k"])] = r["v"]
    return {ls[i]: ks[j] for i, j in enumerate(best_assignment(a)[0])}


def nearest_centres(df: DataFrame, vec: str, centres: DataFrame, key: str) -> DataFrame:
    """(key, cluster) by smallest cosine distance; centres (cluster, mean), few."""
    rows = unit(df.select(key, vec), vec).crossJoin(bounded(unit(centres, "mean", "centre").select("cluster", "centre")))
    w = Window.partitionBy(key).orderBy(F.desc(dot(F.col("unit"), F.col("centre"))), "cluster")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "cluster")


def robust_cluster(df: DataFrame, vec: str, key: str, ks: list[int], repeats: int = 3, method: str = "kmeans", **kw) -> tuple[int, DataFrame]:
    """(k, rows with cluster) by k-means ('kmeans') or Gaussian mixtures ('mixture')."""
    if method == "kmeans":
        return kmeans_range(df, vec, key, ks, repeats, **kw)[:2]
    if method == "mixture":
        return gaussian_mixture(df, vec, ks, repeats, **kw)[:2]
    raise ValueError(f"no such method: {method}")


def linkage(df: DataFrame, vec: str, key: str, most: int = 2000) -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of each merge of complete linkage by cosine distance. Rows in the order of key are 0, 1, ..;
    the merge in step s makes n + s. Needs all pairs, so more than most rows are an error."""
    got = df.select(key, vec).orderBy(key).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    x = np.array([[float(v) for v in r[1]] for r in got], float).reshape(len(got), -1)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    d = 1 - u @ u.T
    n, out = len(x), []
    names, sizes = list(range(n)), [1] * n
    np.fill_diagonal(d, np.inf)
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        out.append((min(names[i], names[j]), max(names[i], names[j]), float(d[i, j]), sizes[i] + sizes[j]))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        names[i], sizes[i] = n + step, sizes[i] + sizes[j]
    return out
