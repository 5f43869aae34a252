"""Mixing sources to target weights by Poisson replication.

Each source s has n_s rows and a target share w_s of the output. With T output rows wanted, a row of s must
appear r_s = w_s * T / n_s times on average. Its count is drawn by inverting the Poisson(r_s) distribution at
u, a number in (0, 1) made from md5(seed:id); the row is exploded by the count and the copies are shuffled
globally by a hash of (seed, id, copy), where id is doc_id, or a digest of the text where that is null. Everything is DataFrame expressions.

* The distribution of each source is one array of cumulative probabilities, built once a source by summing
  log terms, so that rates over 700 don't underflow; a row only counts the entries below its u.
* Sources are counted in one pass over that column and kept as a table; all else comes from it.
* The table of sources is collected to a broadcast only if it has at most MAX_BROADCAST rows; otherwise it's
  joined, where AQE splits a hot source.
* The shuffle deals by hash of (id, copy), so a hot source is spread over all partitions.

Nulls: a null source is a source of its own; a null doc_id draws by the digest of its text (null as empty), so that such
rows draw on their own unless their texts are equal; a null text is kept. Sources without a weight, or with weight 0,
aren't in the output. Repeated rows draw the same count. Texts of any length are only carried along. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, table

MAX_BROADCAST = 10_000


def identity(doc_id: Column, text: Column) -> Column:
    """What a row draws by: doc_id as text, or 'null:' and the text's md5."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def uniform(seed: int, identity: Column) -> Column:
    """(h + 0.5) / 2**32 with h from the first 8 hex digits of md5('seed:identity')."""
    text = F.concat(F.lit(f"{seed}:"), identity)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def source_rates(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): weights maps sources to target shares; without them the share is n ** temperature.

    epochs is the output size as a multiple of the input.
    """
    sizes = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    all_rows = sizes.agg(F.sum("n").alias("rows"))
    if weights is not None:
        if not weights:
            return sizes.where(F.lit(False)).select("source", "n", F.lit(0.0).alias("rate"))
        pairs = F.create_map(*[F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]) if any(k is not None for k in weights) else None
        w = F.lit(None).cast("double") if pairs is None else F.try_element_at(pairs, F.col("source"))
        w = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(w)
    else:
        w = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    sizes = sizes.withColumn("w", F.coalesce(w, F.lit(0.0))).where("w > 0")
    total = sizes.agg(F.sum("w").alias("sw"))
    return sizes.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_rows)).select("source", "n", (F.col("w") / F.col("sw") * F.col("rows") * F.lit(float(epochs)) / F.col("n")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. rate + 12 sqrt(rate) + 24, beyond which less than 2**-33 is left."""
    top = F.ceil(rate + 12.0 * F.sqrt(rate) + 24.0).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf")),
        lambda a, k: F.struct(
            (a["log_p"] + F.log(rate / k)).alias("log_p"),
            (a["sum"] + F.exp(a["log_p"] + F.log(rate / k))).alias("sum"),
            F.concat(a["cdf"], F.array(a["sum"] + F.exp(a["log_p"] + F.log(rate / k)))).alias("cdf"),
        ),
    )
    return step["cdf"]


def poisson_mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, most_sources: int = MAX_BROADCAST) -> DataFrame:
    """docs' columns and copy (from 0), rate, shuffle_key, which replace columns of these names: each row by its Poisson
    count, globally shuffled."""
    own = [c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    rates = source_rates(docs.select("source"), weights, temperature, epochs)
    cdf = rates.select(F.col("source").alias("of"), F.col("rate"), poisson_cdf(F.col("rate")).alias("cdf"))
    if rates.limit(most_sources + 1).count() <= most_sources:  # checked: at most so many rows
        cdf = F.broadcast(cdf)
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*own).alias("row"), "source", identity(F.col("doc_id"), text).alias("id")).withColumn("u", uniform(seed, F.col("id")))
    drawn = rows.join(cdf, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", F.size(F.filter("cdf", lambda c: c < F.col("u"))))
    copies = drawn.where("times > 0").select("row", "id", "rate", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.col("id"), F.lit("/"), F.col("copy").cast("string")).cast("binary"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.withColumn("shuffle_key", key).repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("row")[c].alias(c) for c in own], "copy", "rate", "shuffle_key")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return poisson_mix(docs).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key")


OP7_SQL = """
WITH sizes AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT count(*) FROM documents) / n AS rate FROM sizes),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM rates),
terms AS (
  SELECT source, k, sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k) - rate AS log_p
  FROM steps),
cdf AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM terms),
named AS (SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS id FROM documents d),
drawn AS (SELECT *, (CAST(CAST('0x' || substr(md5('17:' || id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u FROM named)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.k AS INTEGER) AS copy, md5('17/' || id || '/' || CAST(c.k AS VARCHAR)) AS shuffle_key
FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.p < d.u
"""
