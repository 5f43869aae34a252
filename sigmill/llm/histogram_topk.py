"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, in blocks of at most ``block`` queries; a block (block * dim
integers) is broadcast, the candidates stay where they are and are scored by one matrix product per Arrow
batch. For each query the global histogram of scores over ``bins`` equal ranges is summed from the
partitions' histograms, the range that holds the kth value is found, and that range alone is divided anew (its
last parts may be cut short or empty) until it is one integer wide, or few enough rows to sort are left. A last
pass keeps the scores at or above the kth value.
Ties at the kth value are cut to the k smallest vec_id in each partition before they travel, then globally,
so a vector that fills a third of the table adds at most k rows per partition and query.

Scores are integers: float64 products where length * max|q| * max|c| proves them exact (under 2**53), 64-bit products
where it's under 2**62, and Python's integers beyond that, for those rows only. A wanted score that no long can hold is an
OverflowError. A vector that is null or holds null or non-finite components, or has no vec_id, takes no part; vectors meet
queries of their own length only, empty ones (score 0) too. Repeated rows are separate candidates and one query; different
vectors under one id are separate queries; a query leaves out every row with its own vec_id. No queries, or no candidates,
give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.store import new_table
from .common import materialize, table

EXACT, WIDE = 2.0**53, 2.0**62


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component as double; vectors that can't take part are left out."""

    def fine(c):
        x = F.lit(256.0) * c.cast("double")
        return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)  # beyond, every double is an integer

    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", odd)
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", fine).alias("v"))


def _by_length(batch: pa.RecordBatch):
    """(ids, matrix) for each vector length in the batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    col = batch.column(1)
    flat, off = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    lengths = np.diff(off)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), ids[rows], flat[(off[rows][:, None] + np.arange(n)[None, :])]


def _scores(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Inner products: int64, or Python's integers where those might not do."""
    bound = matrix.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0))
    if bound < EXACT:
        return (queries @ matrix.T).astype(np.int64)
    if bound < WIDE:
        return queries.astype(np.int64) @ matrix.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(queries).dot(whole(matrix).T)


def _sized(matrix: np.ndarray) -> list[np.ndarray]:
    """Row numbers by size, so that few wide rows don't slow the others: any two rows but the last kind's are under WIDE."""
    wide = np.abs(matrix).max(axis=1, initial=0) >= np.sqrt(WIDE / max(matrix.shape[1], 1))
    return [i for i in (np.flatnonzero(~wide), np.flatnonzero(wide)) if len(i)]


class _Block:
    """Queries of one block, rows (vec_id, v), by vector length and size."""

    def __init__(self, rows, most: int = 1024):
        self.ids = np.array([r[0] for r in rows], np.int64)
        lengths = np.array([len(r[1]) for r in rows])
        self.by: dict[int, list] = {}
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            m = np.array([rows[i][1] for i in at], np.float64)
            self.by[int(n)] = [(at[i[j : j + most]], m[i[j : j + most]]) for i in _sized(m) for j in range(0, len(i), most)]

    def scored(self, batch: pa.RecordBatch, step: int = 2048):
        """(query rows, candidate ids, scores, usable) pieces of bounded size."""
        for n, ids, matrix in _by_length(batch):
            for part in _sized(matrix) if n in self.by else ():
                for i in range(0, len(part), step):
                    c = part[i : i + step]
                    for rows, q in self.by[n]:
                        yield rows, ids[c], _scores(q, matrix[c]), self.ids[rows][:, None] != ids[c][None, :]


def _histograms(block, low, width, top, bins):
    """A function for mapInArrow: (query row, bin, count) of its partition; scores outside low..top - 1 don't count, so top is at
    most low + bins * width."""

    def run(batches):
        b, lo, w, end = block.value, low, width, top
        total = np.zeros((len(b.ids), bins), np.int64)
        for batch in batches:
            for rows, _, s, use in b.scored(batch):
                at = (s - lo[rows][:, None]) // w[rows][:, None]
                ok = use & ((at >= 0) & (s < end[rows][:, None])).astype(bool)
                r = np.broadcast_to(np.arange(len(rows))[:, None], s.shape)[ok]
                total[rows] += np.bincount(r * bins + at[ok].astype(np.int64), minlength=len(rows) * bins).reshape(len(rows), bins)
        q, k = np.nonzero(total)
        for i in range(0, len(q), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(q[i : i + 50_000], pa.int64()), pa.array(k[i : i + 50_000], pa.int64()), pa.array(total[q[i : i + 50_000], k[i : i + 50_000]], pa.int64())], ["q", "bin", "n"])

    return run


def _winners(block, least, k):
    """A function for mapInArrow: the partition's k best (score, then smaller id) of each query at or above least; q is the
    query's place in the block."""

    def run(batches):
        b = block.value
        best = {}
        for batch in batches:
            for rows, ids, s, use in b.scored(batch):
                ok = use & (s >= least[rows][:, None]).astype(bool)
                for i in np.flatnonzero(ok.any(axis=1)):
                    at = np.flatnonzero(ok[i])
                    got = best.get(rows[i])
                    sc, vi = s[i, at], ids[at]
                    if got is not None:
                        sc, vi = np.concatenate([got[0], sc]), np.concatenate([got[1], vi])
                    o = np.lexsort((vi, -sc))[:k]
                    best[rows[i]] = (sc[o], vi[o])
        if best:
            q = np.concatenate([np.full(len(v[0]), r, np.int64) for r, v in best.items()])
            score = np.concatenate([v[0] for v in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b.ids[q]), pa.array(np.concatenate([v[1] for v in best.values()])), pa.array(score.tolist() if score.dtype == object else score, pa.int64())], ["q", "query_id", "vec_id", "score"])

    return run


def histogram_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, bins: int = 64, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs as of quantized(). Two or three passes over the candidates for each block;
    a block's winners go to a table, so the plan doesn't grow with the number of blocks."""
    spark, sc = candidates.sparkSession, candidates.sparkSession.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(queries.distinct().withColumn("q", F.monotonically_increasing_id()))
    span = candidates.select(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))))).first()
    path, last, blocks = new_table(spark), -1, 0
    while rows := numbered.where(F.col("q") > last).orderBy("q").limit(block).select("vec_id", "v", "q").collect():  # bounded, so it may be collected and broadcast
        last, blocks, n = rows[-1][2], blocks + 1, len(rows)
        far = int(max(max(abs(x) for r in rows for x in r[1]), 1)) * int(max(span[1] or 1, 1)) * int(span[0] or 1)
        kind = np.int64 if far < WIDE / 4 else object
        low, width = np.full(n, -far, kind), np.full(n, max(1, -(-(2 * far + 1) // bins)), kind)
        top = np.full(n, far + 1, kind)
        above, least, open_ = np.zeros(n, np.int64), np.full(n, -far, kind), np.ones(n, bool)
        shared = sc.broadcast(_Block(rows))
        while open_.any():
            got = candidates.mapInArrow(_histograms(shared, low, width, top, bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most block * bins rows
            counts = np.zeros((n, bins), np.int64)
            counts[got["q"].to_numpy(np.int64), got["bin"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
            for i in np.flatnonzero(open_):
                down = above[i] + np.cumsum(counts[i][::-1])
                hit = np.searchsorted(down, k)
                if hit >= bins:  # fewer than k candidates: all are wanted
                    open_[i] = False
                    continue
                at = bins - 1 - int(hit)
                least[i] = low[i] + at * width[i]
                if width[i] == 1 or down[hit] <= 4 * k:  # exact, or so few that sorting them is all that is left
                    open_[i] = False
                    continue
                above[i] = down[hit] - counts[i][at]
                low[i], top[i] = least[i], min(top[i], least[i] + width[i])  # what lies above is counted already
                width[i] = max(1, -(-width[i] // bins))
            low = np.where(open_, low, 4 * far + 1)  # settled queries take no part in the next pass
        found = candidates.mapInArrow(_winners(shared, least, k), WINNERS).withColumn("block", F.lit(blocks))
        found.write.mode("append").parquet(path)
        shared.unpersist()
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc("vec_id"))
    out = spark.read.schema(f"{WINNERS}, block int").parquet(path).repartition(parts, "block", "q")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


WINNERS = "q long, query_id long, vec_id long, score long"


def op10_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return histogram_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
