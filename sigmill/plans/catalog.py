"""The queries that show each operator on the driver's tables, with the SQL that they are checked against.

Doubles whose last digits depend on the order of summation are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import missing as m, scalar as s
from ..operators import binning, cluster, encode, factorize as fz, order, pivot, post, profile, reduce as rd, spatial, transform as tr, windows as wn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, digits: int = 6):
    return F.round(c, digits)


def gaps(spark, sf):
    """lineitem with every seventh quantity missing, some of them as NaN."""
    q = F.expr("CASE WHEN (l_orderkey * 31 + l_linenumber) % 7 = 0 THEN NULL WHEN (l_orderkey * 31 + l_linenumber) % 7 = 1 THEN double('NaN') ELSE l_quantity END")
    return t(spark, sf, "lineitem").withColumn("q", q)


GAPS = "(SELECT *, CASE WHEN (l_orderkey * 31 + l_linenumber) % 7 IN (0, 1) THEN NULL ELSE l_quantity END AS q FROM lineitem)"


def days(spark, sf):
    """One row a day: total of the events' values."""
    return t(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("d")).agg(r(F.sum("value"), 4).alias("v"))


DAYS = "(SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, round(sum(value), 4) AS v FROM events GROUP BY 1)"
#: Positions on a globe made from keys, so that both sides compute the same ones.
PLACES = "(SELECT s_suppkey, CAST((s_suppkey * 37) % 100 AS DOUBLE) / 10 - 105 AS lon, CAST((s_suppkey * 53) % 100 AS DOUBLE) / 20 + 33 AS lat, s_acctbal FROM supplier)"


def places(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 100).cast("double").__truediv__(10).__sub__(105).alias("lon"), (((F.col("s_suppkey") * 53) % 100).cast("double") / 20 + 33).alias("lat"), "s_acctbal")


# Reductions


@query(f"SELECT l_returnflag, round(sum(q), 4) AS total, round(avg(q), 6) AS mean, max(q) AS largest, min(q) AS least, count(q) AS n FROM {GAPS} GROUP BY 1")
def nan_reductions(spark, sf):
    return gaps(spark, sf).groupBy("l_returnflag").agg(r(m.sum_("q"), 4).alias("total"), r(m.mean("q")).alias("mean"), m.largest("q").alias("largest"), m.smallest("q").alias("least"), m.count("q").alias("n"))


@query(f"SELECT l_returnflag, round(var_samp(q), 5) AS variance, round(stddev_samp(q), 6) AS deviation FROM {GAPS} GROUP BY 1")
def nan_var_std(spark, sf):
    return gaps(spark, sf).groupBy("l_returnflag").agg(r(m.variance("q"), 5).alias("variance"), r(m.deviation("q")).alias("deviation"))


@query(f"SELECT l_linestatus, round(sqrt(sum(q * q)), 5) AS norm, round(sum(q * q), 3) AS squares FROM {GAPS} GROUP BY 1")
def nan_norms(spark, sf):
    return gaps(spark, sf).groupBy("l_linestatus").agg(r(m.norm("q"), 5).alias("norm"), r(m.squares("q"), 3).alias("squares"))


@query(f"SELECT l_returnflag, round(sqrt(avg(power(l_tax * 100 - q, 2))), 6) AS rmse, round(sum(abs(l_tax * 100 - q)), 3) AS l1, round(sqrt(sum(power(l_tax * 100 - q, 2))), 4) AS distance FROM {GAPS} GROUP BY 1")
def pair_metrics(spark, sf):
    d = gaps(spark, sf).withColumn("x", F.col("l_tax") * 100)
    return d.groupBy("l_returnflag").agg(r(m.rmse("x", "q")).alias("rmse"), r(m.l1("x", "q"), 3).alias("l1"), r(m.distance("x", "q"), 4).alias("distance"))


@query(f"SELECT l_returnflag, round(covar_samp(q, l_extendedprice), 2) AS cov, round(corr(q, l_extendedprice), 7) AS cor, round(power(corr(q, l_extendedprice), 2), 7) AS r2 FROM {GAPS} GROUP BY 1")
def cov_cor(spark, sf):
    return gaps(spark, sf).groupBy("l_returnflag").agg(r(m.covariance("q", "l_extendedprice"), 2).alias("cov"), r(m.correlation("q", "l_extendedprice"), 7).alias("cor"), r(m.r2("q", "l_extendedprice"), 7).alias("r2"))


_PAIRS = [(a, b) for a in ("l_quantity", "l_discount") for b in ("l_extendedprice", "l_tax", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(power(corr({a}, {b}), 2), 7) AS r2 FROM lineitem" for a, b in _PAIRS))
def r2_pairs(spark, sf):
    return rd.r2_matrix(t(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax", "l_discount"]).select("x", "y", r("r2", 7).alias("r2"))


_STATS = "SELECT '{c}' AS name, min({c}) AS least, max({c}) AS largest, round(stddev_samp({c}), 4) AS deviation, round((avg(power({c}, 3)) - 3 * avg({c}) * avg({c} * {c}) + 2 * power(avg({c}), 3)) / power(var_pop({c}), 1.5), 4) AS skewness, count({c}) AS n FROM {t}"


@query(" UNION ALL ".join(_STATS.format(c=c, t="part") for c in ("p_size", "p_retailprice")).replace("min(p_size)", "CAST(min(p_size) AS DOUBLE)").replace("max(p_size)", "CAST(max(p_size) AS DOUBLE)"))
def datanalytics(spark, sf):
    return rd.column_statistics(t(spark, sf, "part"), ["p_size", "p_retailprice"]).select("name", "least", "largest", r("deviation", 4).alias("deviation"), r("skewness", 4).alias("skewness"), "n")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 3")
def bincount(spark, sf):
    return rd.value_counts(t(spark, sf, "part"), "p_brand", 3)


@query("SELECT a.lang, b.source, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang FROM documents) a CROSS JOIN (SELECT DISTINCT source FROM documents) b LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) c ON a.lang = c.lang AND b.source = c.source")
def contingency(spark, sf):
    return rd.contingency(t(spark, sf, "documents"), "lang", "source")


@query("SELECT 0 AS step, l_returnflag AS source, l_linestatus AS target, count(*) AS n FROM lineitem GROUP BY 2, 3 UNION ALL SELECT 1, l_linestatus, CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2, 3")
def contingency_chain(spark, sf):
    return rd.contingency_chain(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT p_type, CAST(least(floor(p_size / 5.0), 9) AS INTEGER) AS bin, count(*) AS n FROM part WHERE p_size <= 50 GROUP BY 1, 2")
def histogram_classes(spark, sf):
    return rd.histogram(t(spark, sf, "part"), "p_size", 0, 5, 10, ["p_type"])


@query("WITH h AS (SELECT CAST(CASE WHEN l_quantity = 0 THEN 0 ELSE ceil(l_quantity / 10) - 1 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n, n / (SELECT sum(n) FROM h) AS share FROM h WHERE bin BETWEEN 0 AND 4")
def histogram_share(spark, sf):
    return rd.histogram(t(spark, sf, "lineitem"), "l_quantity", 0, 10, 5, closed="right", proportion=True)


@query("WITH r AS (SELECT k AS run, l_linenumber AS i, CAST(l_suppkey % 5 AS INTEGER) AS j, sum(l_quantity * (1 + (l_orderkey * k) % 3)) AS v FROM lineitem, range(1, 4) AS g(k) GROUP BY 1, 2, 3) SELECT i, j, min(v) AS least, max(v) AS largest, round(var_samp(v), 2) AS variance FROM r GROUP BY 1, 2")
def ensemble_min_max_var(spark, sf):
    runs = t(spark, sf, "lineitem").select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 5).cast("int").alias("j"), "l_quantity", "l_orderkey")
    runs = runs.groupBy("run", "i", "j").agg(F.sum(F.col("l_quantity") * (1 + (F.col("l_orderkey") * F.col("run")) % 3)).alias("v"))
    return rd.ensemble_ranges(runs).select("i", "j", "least", "largest", r("variance", 2).alias("variance"))


@query("SELECT avg_.p_brand, round(avg(abs(p.p_retailprice - avg_.e)), 5) AS mae, round(sqrt(avg(power(p.p_retailprice - avg_.e, 2))), 5) AS rmse, round(max(abs(p.p_retailprice - avg_.e)), 5) AS largest, count(*) AS n FROM part p JOIN (SELECT p_brand, p_type, avg(p_retailprice) AS e FROM part GROUP BY 1, 2) avg_ ON p.p_brand = avg_.p_brand AND p.p_type = avg_.p_type GROUP BY 1")
def compress_eval(spark, sf):
    p = t(spark, sf, "part")
    e = p.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("e"))
    d = p.join(e, ["p_brand", "p_type"])
    x = m.value("p_retailprice") - m.value("e")
    return d.groupBy("p_brand").agg(r(F.avg(F.abs(x)), 5).alias("mae"), r(m.rmse("p_retailprice", "e"), 5).alias("rmse"), r(F.max(F.abs(x)), 5).alias("largest"), F.count(x).alias("n"))


@query("SELECT s.s_nationkey, CAST('p_attr' AS VARCHAR) AS attribute FROM supplier s GROUP BY 1 HAVING count(CASE WHEN s_acctbal < -900 THEN 1 END) = 0")
def missing_attributes(spark, sf):
    d = t(spark, sf, "supplier").withColumn("p_attr", F.when(F.col("s_acctbal") < -900, F.col("s_acctbal")))
    return rd.missing_attributes(d, "s_nationkey", ["p_attr"])


# Ordered operators


@query(f"SELECT d, round(sum(CASE WHEN day(CAST(d AS DATE)) % 5 = 0 THEN 0 ELSE v END) OVER (ORDER BY d), 3) AS cum FROM {DAYS}")
def cumsum_nan(spark, sf):
    d = days(spark, sf).withColumn("v", F.when(F.dayofmonth(F.col("d").cast("date")) % 5 != 0, F.col("v")))
    return wn.cumulative_sum(d, "v", "d").select("d", r("cum", 3).alias("cum"))


@query(f"SELECT d, round(avg(v) OVER (ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) AS mean FROM {DAYS}")
def moving_avg_odd(spark, sf):
    return wn.moving_mean(days(spark, sf), "v", "d", 3).select("d", r("mean", 5).alias("mean"))


@query(f"SELECT d, round(avg(v) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 5) AS mean FROM {DAYS}")
def moving_avg_even(spark, sf):
    return wn.moving_mean(days(spark, sf), "v", "d", 4).select("d", r("mean", 5).alias("mean"))


@query(f"SELECT d, round(max(v) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS near FROM {DAYS}")
def moving_window_max(spark, sf):
    return wn.neighbourhood(days(spark, sf), "v", "d", 2, F.max).select("d", r("near", 4).alias("near"))


@query("WITH c AS (SELECT CAST(user_id % 12 AS INTEGER) AS i, CAST(day(ts) AS INTEGER) AS j, sum(value) AS v FROM events GROUP BY 1, 2) SELECT a.i, a.j, round(avg(b.v), 4) AS near FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2")
def moving_window_2d(spark, sf):
    c = t(spark, sf, "events").groupBy((F.col("user_id") % 12).cast("int").alias("i"), F.dayofmonth("ts").alias("j")).agg(F.sum("value").alias("v"))
    return wn.neighbourhood_nd(c, ["i", "j"]).select("i", "j", r("near", 4).alias("near"))


@query(f"SELECT d, round(coalesce((lead(v) OVER w - lag(v) OVER w) / 2, lead(v) OVER w - v, v - lag(v) OVER w), 5) AS slope FROM {DAYS} WINDOW w AS (ORDER BY d)")
def slopes(spark, sf):
    return wn.slopes(days(spark, sf), "v", "d").select("d", r("slope", 5).alias("slope"))


@query(f"SELECT round(min(x), 4) AS least, round(max(x), 4) AS largest, round(max(x) - min(x), 4) AS spread FROM (SELECT v - lag(v) OVER (ORDER BY d) AS x FROM {DAYS})")
def minmax_dx(spark, sf):
    return wn.step_range(days(spark, sf), "v", "d").select(*[r(c, 4).alias(c) for c in ("least", "largest", "spread")])


_UD = "(SELECT user_id, day(ts) AS d, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"


def user_days(spark, sf):
    return t(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(r(F.sum("value"), 4).alias("v"))


@query(f"SELECT user_id, min(CASE WHEN v > 50 THEN d END) AS first, max(CASE WHEN v > 20 THEN d END) AS last, max(CASE WHEN v > 20 THEN d END) - min(CASE WHEN v > 50 THEN d END) + 1 AS span FROM {_UD} GROUP BY 1")
def data_window(spark, sf):
    return wn.data_window(user_days(spark, sf), "d", F.col("v") > 50, F.col("v") > 20, ["user_id"]).select("user_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "span")])


@query(f"WITH e AS (SELECT user_id, d, v FROM {_UD}), f AS (SELECT user_id, min(d) AS a, max(d) AS b FROM e WHERE v > 0 GROUP BY 1) SELECT e.user_id, e.d - a + 1 AS place, v FROM e JOIN f ON e.user_id = f.user_id WHERE d BETWEEN a AND b")
def shifted_series(spark, sf):
    return wn.left_aligned(user_days(spark, sf), "v", "d", ["user_id"]).select("user_id", F.col("place").cast("long").alias("place"), "v")


@query("WITH e AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, min(event_id) AS place FROM e WHERE a = 'view' AND b = 'click' AND c = 'view' GROUP BY 1")
def subsequence(spark, sf):
    return wn.pattern_places(t(spark, sf, "events"), "event_type", "event_id", ["view", "click", "view"], ["user_id"])


_PEAKS = """WITH RECURSIVE y AS (SELECT user_id, list(v ORDER BY d) AS y, list(d ORDER BY d) AS ds, CAST(count(*) AS INTEGER) AS n, CAST(least(7, count(*)) AS INTEGER) AS lag FROM {ud} GROUP BY 1),
s AS (
  SELECT user_id, y, ds, n, lag, lag - 1 AS p, y AS kept, list_avg(y[1:lag]) AS mean, list_stddev_samp(y[1:lag]) AS dev, 0 AS sig FROM y WHERE lag > 1
  UNION ALL
  SELECT user_id, y, ds, n, lag, p, kept, list_avg(kept[p - lag + 1 : p]), list_stddev_samp(kept[p - lag + 1 : p]), sig FROM (
    SELECT user_id, y, ds, n, lag, p, sig, CASE WHEN sig = 0 THEN kept ELSE list_concat(list_concat(kept[1 : p - 1], [{f} * y[p] + (1 - {f}) * kept[p - 1]]), y[p + 1 :]) END AS kept FROM (
      SELECT user_id, y, ds, n, lag, p + 1 AS p, kept, CASE WHEN abs(y[p + 1] - mean) > 2.5 * dev THEN CASE WHEN y[p + 1] > mean THEN 1 ELSE -1 END ELSE 0 END AS sig FROM s WHERE p + 1 < n))),
z AS (SELECT u.user_id, u.d, u.v, coalesce(sig, 0) AS signal, coalesce(mean, 0) AS mean, coalesce(dev, 0) AS dev FROM {ud} u LEFT JOIN s ON s.user_id = u.user_id AND s.ds[s.p] = u.d)
"""


@query(_PEAKS.format(ud=_UD, f=0.2) + "SELECT user_id, d, v, CAST(signal AS BIGINT) AS signal, round(mean, 6) AS mean, round(dev, 5) AS dev FROM z")
def peaks_zscore(spark, sf):
    found = wn.peaks(user_days(spark, sf), "v", "d", ["user_id"], lag=7, threshold=2.5, influence=0.2)
    return found.select("user_id", F.col("d").cast("long").alias("d"), "v", "signal", r("filtered_mean").alias("mean"), r("filtered_deviation", 5).alias("dev"))


@query(_PEAKS.format(ud=_UD, f=0.0) + ", o AS (SELECT user_id, d, signal, lead(signal) OVER (PARTITION BY user_id ORDER BY d) AS next FROM z), f AS (SELECT user_id, min(d) AS rise FROM o WHERE signal = 0 AND next = 1 GROUP BY 1) SELECT z.user_id, min(CASE WHEN v > 0 AND (rise IS NULL OR d >= rise) THEN d END) AS place FROM z LEFT JOIN f ON z.user_id = f.user_id GROUP BY 1 HAVING sum(v) <> 0 AND place IS NOT NULL")
def first_jump(spark, sf):
    return wn.first_jump(user_days(spark, sf), "v", "d", ["user_id"], lag=7, threshold=2.5).select("user_id", F.col("place").cast("long").alias("place"))


# Sorts and selections


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END ASC NULLS FIRST, s_suppkey) AS INTEGER) AS place FROM supplier")
def argsort_nan(spark, sf):
    d = t(spark, sf, "supplier").withColumn("b", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")))
    return order.sort_places(d, "b", "s_suppkey").select("s_suppkey", "place")


@query("SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def topk_by_group(spark, sf):
    return order.top_by_group(t(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey", 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


_W = "(SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, ((i * 7919 + k * 104729) % 1000 + 1) / 1001.0 AS w FROM range(0, 40) a(i), range(0, 3) b(k))"
_H = "(SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, ((j * 15485863 + k * 32452843) % 1000 + 1) / 1001.0 AS h FROM range(0, 3) a(k), range(0, 6) b(j))"


def arithmetic(spark):
    """Factors made by arithmetic on their indices: W 40 x 3 and H 3 x 6."""
    w = spark.range(120).select((F.col("id") % 40).alias("i"), F.floor(F.col("id") / 40).alias("k")).select(F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k"), (((F.col("i") * 7919 + F.col("k") * 104729) % 1000 + 1) / 1001.0).alias("w"))
    h = spark.range(18).select((F.col("id") % 6).alias("j"), F.floor(F.col("id") / 6).alias("k")).select(F.col("k").cast("int").alias("k"), F.col("j").cast("int").alias("j"), (((F.col("j") * 15485863 + F.col("k") * 32452843) % 1000 + 1) / 1001.0).alias("h"))
    return w, h


@query(f"WITH a AS (SELECT k, sum(w) AS a FROM {_W} GROUP BY 1), b AS (SELECT k, sum(h) AS b FROM {_H} GROUP BY 1) SELECT a.k, round(a * b, 7) AS total, CAST(row_number() OVER (ORDER BY a * b DESC) AS INTEGER) AS place FROM a JOIN b ON a.k = b.k")
def signal_order(spark, sf):
    return order.signal_order(*arithmetic(spark)).select("k", r("total", 7).alias("total"), "place")


@query(f"SELECT i, j, round(sum(w * h), 8) AS v FROM {_W} a JOIN {_H} b ON a.k = b.k GROUP BY 1, 2")
def reconstruct(spark, sf):
    return rd.reconstruction(*arithmetic(spark)).select("i", "j", r("v", 8).alias("v"))


@query(f"WITH p AS (SELECT i, j, a.k, w * h AS p FROM {_W} a JOIN {_H} b ON a.k = b.k), o AS (SELECT j, k, var_samp(p) AS own FROM p GROUP BY 1, 2), x AS (SELECT j, var_samp(v) AS whole FROM (SELECT i, j, sum(p) AS v FROM p GROUP BY 1, 2) GROUP BY 1), s AS (SELECT o.j, k, own / whole AS share FROM o JOIN x ON o.j = x.j) SELECT j, k, round(share / max(share) OVER (PARTITION BY j), 7) AS share FROM s")
def signal_statistics(spark, sf):
    return rd.signal_shares(*arithmetic(spark)).select("j", "k", r("share", 7).alias("share"))


@query(f"WITH s AS (SELECT k, i, w / max(w) OVER (PARTITION BY k) AS share FROM {_W}) SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY share DESC, i) AS INTEGER) AS place, i AS name, round(share, 9) AS share FROM s WHERE share >= 0.5")
def signal_members(spark, sf):
    w, _ = arithmetic(spark)
    return order.signal_members(w.select(F.col("i").alias("name"), "k", F.col("w").alias("v"))).select("k", "place", "name", r("share", 9).alias("share"))


@query(f"SELECT name, k, v FROM (SELECT i AS name, k, w AS v, row_number() OVER (PARTITION BY i ORDER BY w DESC, k) AS r FROM {_W}) WHERE r = 1")
def strongest_signal(spark, sf):
    w, _ = arithmetic(spark)
    return order.strongest_signal(w.select(F.col("i").alias("name"), "k", F.col("w").alias("v"))).select("name", F.col("k").cast("int").alias("k"), "v")


@query("WITH x AS (SELECT p_partkey, p_brand, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rk FROM part), y AS (SELECT *, CASE WHEN p_partkey IN (3, 5) THEN 0 WHEN row_number() OVER (PARTITION BY p_brand ORDER BY rk, p_partkey) = 1 THEN 1 ELSE 2 END AS tier FROM x) SELECT p_partkey, rk, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY tier, rk, p_partkey) AS place FROM y) WHERE place <= 30")
def importance_rank(spark, sf):
    x = order.sort_places(t(spark, sf, "part"), "p_retailprice", "p_partkey", descending=True).withColumnRenamed("place", "rk")
    return order.important(x, "p_partkey", "rk", "p_brand", [3, 5], 30).select("p_partkey", "rk", "place")


@query(f"WITH p AS {PLACES}, b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, avg(lon) AS cx, avg(lat) AS cy FROM p), c AS (SELECT p.*, b.*, least(floor((lon - x0) / (x1 - x0) * 4), 3) AS i, least(floor((lat - y0) / (y1 - y0) * 4), 3) AS j, round(power(lon - cx, 2) + power(lat - cy, 2), 9) AS far FROM p, b) SELECT s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY far DESC, s_suppkey) AS r FROM c) WHERE r = 1 OR lon IN (x0, x1) OR lat IN (y0, y1)")
def grid_thinned(spark, sf):
    return order.grid_thinned(places(spark, sf), "lon", "lat", "s_suppkey", 4).select("s_suppkey")


@query(f"WITH p AS {PLACES}, x AS (SELECT u FROM (SELECT u, row_number() OVER (ORDER BY u) AS r FROM (SELECT DISTINCT round(lon, 6) AS u FROM p)) WHERE (r - 1) % 2 = 0), y AS (SELECT u FROM (SELECT u, row_number() OVER (ORDER BY u) AS r FROM (SELECT DISTINCT round(lat, 6) AS u FROM p)) WHERE (r - 1) % 2 = 0) SELECT s_suppkey FROM p WHERE round(lon, 6) IN (SELECT u FROM x) AND round(lat, 6) IN (SELECT u FROM y)")
def grid_reduction(spark, sf):
    return order.grid_reduced(places(spark, sf), "lon", "lat", 2).select("s_suppkey")


# Encoding


@query("WITH l AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) AS level FROM part GROUP BY 1) SELECT p_partkey, CAST(level AS INTEGER) AS level, CAST(p.p_brand = l.p_brand AS INTEGER) AS code FROM part p CROSS JOIN l")
def one_hot(spark, sf):
    return encode.one_hot(t(spark, sf, "part"), "p_brand", "p_partkey")


@query("WITH l AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) AS level FROM orders GROUP BY 1) SELECT o_orderkey, CAST(level AS DOUBLE) AS value FROM orders o JOIN l ON o.o_orderpriority = l.o_orderpriority")
def one_hot_decode(spark, sf):
    codes = encode.one_hot(t(spark, sf, "orders"), "o_orderpriority", "o_orderkey")
    return encode.decode(codes.where("code = 1").select("o_orderkey", "level", "code"), "o_orderkey", {i: float(i) for i in range(1, 6)})


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_discount > 0.05 THEN '2' ELSE '1' END) || (CASE WHEN l_tax > 0.06 THEN '3' WHEN l_tax > 0.05 THEN '2' ELSE '1' END) AS code FROM lineitem) SELECT code, count(*) AS n FROM c GROUP BY 1")
def types_code(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("_k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    d = d.withColumn("a", F.when(F.col("l_discount") > 0.05, 0.3).otherwise(0.0)).withColumn("b", F.when(F.col("l_tax") > 0.06, 1.0).when(F.col("l_tax") > 0.05, 0.2).otherwise(0.0))
    return encode.level_types(d, ["a", "b"], "_k").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# Transforms


@query("SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def minmax_norm(spark, sf):
    return tr.minmax(t(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", r("c_acctbal", 9).alias("c_acctbal"))


@query("SELECT c_custkey, round((hi - c_acctbal) / (hi - lo), 9) AS c_acctbal FROM (SELECT *, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi FROM customer) WHERE hi > lo")
def minmax_rev(spark, sf):
    d = t(spark, sf, "customer")
    many = d.groupBy("c_nationkey").agg(F.count_distinct("c_acctbal").alias("_n")).where("_n > 1")
    return tr.minmax(d.join(many, "c_nationkey", "left_semi"), ["c_acctbal"], reverse=True, by=["c_nationkey"]).select("c_custkey", r("c_acctbal", 9).alias("c_acctbal"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - least(l_quantity, l_discount, l_tax)) / (greatest(l_quantity, l_discount, l_tax) - least(l_quantity, l_discount, l_tax)), 9) AS l_quantity, round((l_tax - least(l_quantity, l_discount, l_tax)) / (greatest(l_quantity, l_discount, l_tax) - least(l_quantity, l_discount, l_tax)), 9) AS l_tax FROM lineitem")
def minmax_rows(spark, sf):
    return tr.minmax_rows(t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("l_quantity", 9).alias("l_quantity"), r("l_tax", 9).alias("l_tax"))


@query("SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS scaled, round(c_acctbal, 5) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def denorm_roundtrip(spark, sf):
    d = t(spark, sf, "customer")
    lo, hi = d.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    scaled = tr.minmax(d, ["c_acctbal"]).withColumn("scaled", r("c_acctbal", 9))
    return tr.denormalize(scaled, {"c_acctbal": (lo, hi)}).select("c_custkey", "scaled", r("c_acctbal", 5).alias("c_acctbal"))


@query("WITH s AS (SELECT c_custkey, log10(c_acctbal - lo + 1) AS y FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)) SELECT c_custkey, round((y - a) / (b - a), 7) AS c_acctbal FROM s, (SELECT min(y) AS a, max(y) AS b FROM s)")
def log_norm(spark, sf):
    return tr.log_scaled(t(spark, sf, "customer"), "c_acctbal").select("c_custkey", r("c_acctbal", 7).alias("c_acctbal"))


@query("WITH s AS (SELECT c_custkey, c_acctbal, log10(c_acctbal - lo + 1) AS y FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)) SELECT c_custkey, round((y - a) / (b - a), 7) AS scaled, round(c_acctbal, 4) AS c_acctbal FROM s, (SELECT min(y) AS a, max(y) AS b FROM s)")
def log_norm_roundtrip(spark, sf):
    scaled = tr.log_scaled(t(spark, sf, "customer"), "c_acctbal").withColumn("scaled", r("c_acctbal", 7))
    return tr.log_unscaled(scaled, "c_acctbal").select("c_custkey", "scaled", r("c_acctbal", 4).alias("c_acctbal"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log10(CASE WHEN c_acctbal > 0 THEN c_acctbal END) ELSE lo - 1 END, 8) AS v FROM customer, (SELECT min(log10(c_acctbal)) AS lo FROM customer WHERE c_acctbal > 0)")
def log10_safe(spark, sf):
    d = tr.with_stats(t(spark, sf, "customer"), {"_lo": F.min(F.log10(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))))})
    return d.select("c_custkey", r(s.log10_floor("c_acctbal", F.col("_lo")), 8).alias("v"))


@query("SELECT s_suppkey, round(s_acctbal / hi, 9) AS s_acctbal FROM supplier, (SELECT max(s_acctbal) AS hi FROM supplier)")
def scale_by_max(spark, sf):
    return tr.over_largest(t(spark, sf, "supplier"), ["s_acctbal"]).select("s_suppkey", r("s_acctbal", 9).alias("s_acctbal"))


@query("SELECT s_suppkey, round(lo + hi - s_acctbal, 6) AS s_acctbal FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def flip(spark, sf):
    return tr.reflect(t(spark, sf, "supplier"), ["s_acctbal"]).select("s_suppkey", r("s_acctbal").alias("s_acctbal"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(q, mean), 7) AS q FROM {GAPS}, (SELECT avg(q) AS mean FROM {GAPS})")
def impute_mean(spark, sf):
    return tr.impute_mean(gaps(spark, sf), ["q"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("q", 7).alias("q"))


@query(f"SELECT l_returnflag, sum(coalesce(q, 1)) AS total FROM {GAPS} GROUP BY 1")
def fill_const(spark, sf):
    return gaps(spark, sf).groupBy("l_returnflag").agg(F.sum(m.filled("q", 1.0)).alias("total"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def mask_le(spark, sf):
    return tr.mask_at_most(t(spark, sf, "supplier"), ["s_acctbal"], 0).select("s_suppkey", "s_acctbal")


@query("SELECT s.s_suppkey, CASE WHEN n.n_regionkey = 1 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def mask_by_rows(spark, sf):
    bad = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return tr.mask_rows(t(spark, sf, "supplier"), bad, ["s_nationkey"], ["s_acctbal"]).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1.0 END AS c_acctbal FROM customer")
def recoup_rows(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return tr.reinsert_rows(d.where("c_acctbal > 0"), d, ["c_custkey"], -1.0)


@query("SELECT r_regionkey, CAST(NULL AS DOUBLE) AS extra, r_name FROM region")
def recoup_columns(spark, sf):
    return tr.reinsert_columns(t(spark, sf, "region"), ["r_regionkey", "extra", "r_name"])


@query("SELECT c.c_custkey AS target, n.n_name FROM customer c LEFT JOIN nation n ON (CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE c.c_nationkey END) = n.n_nationkey")
def gather(spark, sf):
    mapping = t(spark, sf, "customer").select(F.col("c_custkey").alias("target"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("source"))
    return tr.gather(t(spark, sf, "nation"), mapping, "n_nationkey", "target", "source", ["n_name"])


@query("WITH q AS (SELECT CAST(g AS DOUBLE) AS x FROM range(0, 12) a(g)) SELECT x, round(CASE WHEN x < 4 THEN 10 + (x - 2) * 5 WHEN x < 8 THEN 20 + (x - 4) * 0.5 ELSE 22 + (x - 8) * -10 END, 9) AS y FROM (SELECT x FROM q) WHERE CASE WHEN x < 4 THEN 10 + (x - 2) * 5 WHEN x < 8 THEN 20 + (x - 4) * 0.5 ELSE 22 + (x - 8) * -10 END >= 0 UNION ALL SELECT x, 0.0 FROM (SELECT x FROM q) WHERE 22 + (x - 8) * -10 < 0 AND x >= 8")
def interpolate(spark, sf):
    points = spark.range(4).select(((F.col("id") + 1) * 2).cast("double").alias("x"), F.element_at(F.array(*[F.lit(v) for v in (10.0, 20.0, None, 22.0)]), (F.col("id") + 1).cast("int")).alias("y")).union(spark.range(1).select(F.lit(10.0), F.lit(2.0)))
    return tr.interpolate(points, spark.range(12).select(F.col("id").cast("double").alias("x")), "x", "y").select("x", r("y", 9).alias("y"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 5 = 2 THEN 0.0 ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) END AS v FROM events""")
def coerce_strings(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'bad' WHEN event_id % 5 = 2 THEN '-2' ELSE regexp_extract(props, '(\\\\d+)', 1) END").alias("v"))
    return tr.coerce(e, ["v"], negatives=False)


@query("SELECT r_regionkey AS region, r_name AS title FROM region")
def rename_columns(spark, sf):
    return tr.rename(t(spark, sf, "region"), {"key": "region", "r_name": "title", "name": "wrong"}, "end").withColumnsRenamed({"region": "region"})


_CELLS = "(SELECT CAST(user_id % 4 AS INTEGER) AS a, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS b, CAST(day(ts) % 3 AS INTEGER) AS c, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3)"


def cells3(spark, sf):
    kind = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
    return t(spark, sf, "events").groupBy((F.col("user_id") % 4).cast("int").alias("a"), kind.alias("b"), (F.dayofmonth("ts") % 3).cast("int").alias("c")).agg(r(F.sum("value"), 4).alias("v"))


@query(f"SELECT CAST(a + (SELECT max(a) + 1 FROM {_CELLS}) * c AS BIGINT) AS row, b AS col, v FROM {_CELLS}")
def flatten_tensor(spark, sf):
    return tr.unfold(cells3(spark, sf), ["a", "b", "c"], "b")


@query("SELECT c_custkey AS i, CAST(j AS INTEGER) AS j, v FROM (SELECT c_custkey, 0 AS j, CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN c_acctbal > 0 THEN c_acctbal END FROM customer) WHERE v IS NOT NULL")
def wide_to_cells(spark, sf):
    return tr.to_cells(tr.mask_at_most(t(spark, sf, "customer"), ["c_acctbal"], 0), "c_custkey", ["c_nationkey", "c_acctbal"])


@query("SELECT a.r_name || ':' || b.p_type AS name FROM (SELECT DISTINCT r_name FROM region) a CROSS JOIN (SELECT DISTINCT p_type FROM part) b")
def name_products(spark, sf):
    return tr.name_products(t(spark, sf, "region"), t(spark, sf, "part"), "r_name", "p_type")


_ACC = "(SELECT CAST(c_nationkey AS INTEGER) AS i, c_custkey AS j, abs(c_acctbal) + 1 AS v FROM customer)"


@query(f"WITH s AS (SELECT i, (avg(power(v, 3)) - 3 * avg(v) * avg(v * v) + 2 * power(avg(v), 3)) / power(var_pop(v), 1.5) > 1 OR log10(max(v)) - log10(min(v)) > 1.5 AS logged FROM {_ACC} GROUP BY 1), y AS (SELECT a.i, j, logged, CASE WHEN logged THEN log10(v) ELSE v END AS y FROM {_ACC} a JOIN s ON a.i = s.i) SELECT i, j, logged, round((y - min(y) OVER (PARTITION BY i)) / (max(y) OVER (PARTITION BY i) - min(y) OVER (PARTITION BY i)), 7) AS v FROM y")
def minmax_auto_log(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("i"), F.col("c_custkey").alias("j"), (F.abs("c_acctbal") + 1).alias("v"))
    return tr.minmax_auto_log(c, "i").select("i", "j", "logged", r("v", 7).alias("v"))


@query(f"SELECT w.i, w.k, CASE WHEN w.i % 5 <> 0 THEN w END AS w FROM {_W} w")
def mask_mixers(spark, sf):
    w, h = arithmetic(spark)
    cells = rd.reconstruction(w, h).withColumn("v", F.when(F.col("i") % 5 != 0, F.col("v")))
    return tr.mask_mixers(w, cells).select("i", "k", "w")


@query()
def latin_hypercube(spark, sf):
    return s.latin_hypercube_points(spark, 50, [10.0, 20.0])


@query(f"WITH d AS (SELECT s_suppkey, least(abs(lat - 33), abs(lat - 37), abs(lon + 105), abs(lon + 96)) AS q FROM {PLACES} WHERE lat BETWEEN 33 AND 37 AND lon BETWEEN -105 AND -96) SELECT s_suppkey FROM d WHERE q <= 0.16")
def near_outline(spark, sf):
    box = [(-105.0, 33.0), (-96.0, 33.0), (-96.0, 37.0), (-105.0, 37.0)]
    inside = places(spark, sf).where("lat between 33 and 37 and lon between -105 and -96")
    return spatial.near_outline(inside, "lon", "lat", "s_suppkey", box, 0.16, most=10**6).select("s_suppkey")


@query()
def selection_table(spark, sf):
    rows = user_types(spark, sf)
    ids = rows.select("id").withColumn("i", F.row_number().over(Window.orderBy("id")) - 1)
    cells = rows.join(ids, "id").select("i", F.posexplode("x").alias("j", "v"))
    return fz.selection_table(fz.sweep(rows, [2, 3], fz.Options(runs=4, max_iter=300)), cells)


# Bins and pivots


@query("WITH b AS (SELECT p_partkey, ceil((p_size - lo) / CAST(hi - lo AS DOUBLE) * 8) AS b FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)), z AS (SELECT count(*) AS z FROM b WHERE b = 0) SELECT p_partkey, CAST(CASE WHEN z > 1 THEN b + 1 WHEN b = 0 THEN 1 ELSE b END AS INTEGER) AS bin FROM b, z")
def indicize_bins(spark, sf):
    return binning.bin_index(t(spark, sf, "part"), "p_size", 8).select("p_partkey", "bin")


@query("WITH b AS (SELECT p_partkey, ceil((p_retailprice - lo) / (hi - lo) * ceil((hi - lo) / 100)) AS b, ceil((hi - lo) / 100) AS n FROM part, (SELECT floor(min(p_retailprice) / 100) * 100 AS lo, ceil(max(p_retailprice) / 100) * 100 AS hi FROM part)), z AS (SELECT count(*) AS z FROM b WHERE b = 0) SELECT p_partkey, CAST(n + 1 - (CASE WHEN z > 1 THEN b + 1 WHEN b = 0 THEN 1 ELSE b END) AS INTEGER) AS bin FROM b, z")
def indicize_steps(spark, sf):
    return binning.bin_index(t(spark, sf, "part"), "p_retailprice", step=100.0, reverse=True).select("p_partkey", "bin")


@query("SELECT CAST(i + 1 AS INTEGER) AS bin, round(lo + (hi - lo) * (2 * i + 1) / 14.0, 8) AS centre FROM range(0, 7) a(i), (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)")
def bin_coords(spark, sf):
    return binning.bin_centres(t(spark, sf, "lineitem"), "l_extendedprice", 7).select("bin", r("centre", 8).alias("centre"))


_BIN = "CASE WHEN (SELECT count(*) FROM lineitem WHERE {c} = (SELECT min({c}) FROM lineitem)) > 1 THEN 1 ELSE 0 END"


@query("WITH a AS (SELECT l_extendedprice AS z, ceil((l_quantity - q0) / (q1 - q0) * 5) AS bx, ceil((l_discount - d0) / (d1 - d0) * 4) AS by_ FROM lineitem, (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem)), s AS (SELECT count(CASE WHEN bx = 0 THEN 1 END) AS zx, count(CASE WHEN by_ = 0 THEN 1 END) AS zy FROM a), g AS (SELECT CAST(CASE WHEN zx > 1 THEN bx + 1 WHEN bx = 0 THEN 1 ELSE bx END AS INTEGER) AS ix, CAST(CASE WHEN zy > 1 THEN by_ + 1 WHEN by_ = 0 THEN 1 ELSE by_ END AS INTEGER) AS iy, z FROM a, s) SELECT ix, iy, round(avg(z), 3) AS mean, count(z) AS n FROM g GROUP BY 1, 2")
def grid_mean(spark, sf):
    return binning.grid_mean(t(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 5, 4, every_cell=False).select("ix", "iy", r("mean", 3).alias("mean"), "n")


@query("SELECT o_orderkey, CAST((year(o_orderdate) - y) * 12 + month(o_orderdate) - mo + 1 AS INTEGER) AS bin FROM orders, (SELECT year(min(o_orderdate)) AS y, month(min(o_orderdate)) AS mo FROM orders)")
def time_bins(spark, sf):
    return binning.time_bin(t(spark, sf, "orders"), "o_orderdate", "month").select("o_orderkey", "bin")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id AS id, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def df2matrix(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return pivot.date_matrix(e, "user_id", "d", "value").select(F.col("date").cast("string").alias("date"), "id", r("v", 4).alias("v"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, " + ", ".join(f"round(sum(CASE WHEN event_type = '{e}' THEN value END), 4) AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def df2matrix_wide(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.to_date("ts"))
    names = ["click", "error", "purchase", "signup", "view"]
    return pivot.date_matrix(e, "event_type", "d", "value", ids=names, wide=True).select(F.col("date").cast("string").alias("date"), *[r(n, 4).alias(n) for n in names])


@query("WITH m AS (SELECT o_custkey AS id, year(o_orderdate) * 12 + month(o_orderdate) AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), f AS (SELECT id, min(q) AS a FROM m WHERE v > 0 GROUP BY 1) SELECT m.id, CAST(q - a + 1 AS INTEGER) AS place, round(v, 2) AS v FROM m JOIN f ON m.id = f.id")
def df2matrix_shifted(spark, sf):
    return pivot.shifted_matrix(t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice").select("id", "place", r("v", 2).alias("v"))


# Profiles and checks


_PROF = "SELECT '{c}' AS name, count({c}) AS n, count(CASE WHEN {c} < 0 THEN 1 END) > 0 AS negative, min({c}) = max({c}) AS constant, count(CASE WHEN {c} NOT IN (0, 1) THEN 1 END) = 0 AS boolean FROM {t}"


@query(" UNION ALL ".join(_PROF.format(c=c, t="(SELECT c_acctbal, c_nationkey, CAST(c_custkey % 2 AS INTEGER) AS bit, 7 AS same FROM customer)") for c in ("c_acctbal", "c_nationkey", "bit", "same")))
def profile_columns(spark, sf):
    d = t(spark, sf, "customer").select("c_acctbal", "c_nationkey", (F.col("c_custkey") % 2).cast("int").alias("bit"), F.lit(7).alias("same"))
    return profile.profile(d).select("name", "n", "negative", "constant", "boolean")


@query("SELECT 'twice' AS dropped, 'l_quantity' AS kept, 'correlated' AS why UNION ALL SELECT 'again', 'l_quantity', 'same'")
def correlated_columns(spark, sf):
    d = t(spark, sf, "lineitem").select("l_quantity", F.col("l_quantity").alias("again"), "l_discount", (F.col("l_quantity") * 2 + 1).alias("twice"))
    return spark.createDataFrame(profile.redundant_columns(d, d.columns), "dropped string, kept string, why string")


@query("SELECT user_id AS i, count(CASE WHEN value > 20 THEN 1 END) AS n FROM events GROUP BY 1")
def slice_counts(spark, sf):
    c = t(spark, sf, "events").select(F.col("user_id").alias("i"), F.col("event_type").alias("j"), F.col("value").alias("v"))
    return profile.entry_counts(c, "i", F.col("v") > 20)


@query("SELECT l_suppkey AS i FROM lineitem GROUP BY 1 HAVING count(CASE WHEN l_discount > 0.09 AND l_quantity > 45 THEN 1 END) <= 1")
def bad_slices(spark, sf):
    c = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.when((F.col("l_discount") > 0.09) & (F.col("l_quantity") > 45), 1.0).alias("v"))
    return profile.bad_slices(c, "i", cutoff=1)


_ROUND = "{n}a AS (SELECT * FROM {c} WHERE i IN (SELECT i FROM {c} GROUP BY 1 HAVING count(v) > 3)), {n} AS (SELECT * FROM {n}a WHERE j IN (SELECT j FROM {n}a GROUP BY 1 HAVING count(v) > 3))"


@query("WITH c0 AS (SELECT l_suppkey AS i, l_partkey % 50 AS j, sum(CASE WHEN l_discount > 0.08 THEN l_quantity END) AS v FROM lineitem GROUP BY 1, 2), " + ", ".join(_ROUND.format(n=f"c{q + 1}", c=f"c{q}") for q in range(12)) + " SELECT i, j, v FROM c12")
def robust_cells(spark, sf):
    c = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 50).alias("j")).agg(F.sum(F.when(F.col("l_discount") > 0.08, F.col("l_quantity"))).alias("v"))
    return profile.robust_cells(c, ["i", "j"], cutoff=3)


@query("SELECT count(*) AS rows, count(c_acctbal) AS n, count(DISTINCT c_acctbal) AS kinds, count(CASE WHEN c_acctbal = 0 THEN 1 END) AS zeros, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS negative, min(c_acctbal) AS least, max(c_acctbal) AS largest FROM customer")
def vector_profile(spark, sf):
    return profile.vector_profile(t(spark, sf, "customer"), "c_acctbal")


# Scalars and space


@query(f"WITH p AS {PLACES} SELECT s_suppkey, round(2 * 6372.8 * asin(sqrt(power(sin(radians(lat - 35) / 2), 2) + cos(radians(lat)) * cos(radians(35)) * power(sin(radians(lon + 100) / 2), 2))), 5) AS km FROM p")
def haversine(spark, sf):
    return places(spark, sf).select("s_suppkey", r(s.haversine("lat", "lon", F.lit(35.0), F.lit(-100.0)), 5).alias("km"))


@query(f"WITH p AS {PLACES} SELECT s_suppkey, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone FROM p")
def utm_roundtrip(spark, sf):
    d = places(spark, sf).withColumn("zone", s.utm_zone("lon"))
    x, y = s.utm("lat", "lon", "zone")
    d = d.select("s_suppkey", "zone", x.alias("x"), y.alias("y"))
    lat, lon = s.utm_back("x", "y", "zone")
    return d.select("s_suppkey", r(lat).alias("lat"), r(lon).alias("lon"), "zone")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS delta, round(l_extendedprice * ((l_quantity / 1000 + 1) * 0.011) / ((l_quantity / 1000 + 1) * 0.011 + 1), 6) AS conc FROM lineitem")
def isotope_roundtrip(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("c", s.isotope_concentration("l_quantity", 0.011, "l_extendedprice"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(s.isotope_delta("c", 0.011, "l_extendedprice")).alias("delta"), r("c").alias("conc"))


@query("SELECT CAST(i AS INTEGER) AS month, round(100 * power(1 + 0.5 * 0.02 * i, 1 / 0.5), 7) AS hyperbolic, round(100 * exp(-0.02 * i), 7) AS exponential, CAST(round(100 * (1 + 0.02 * i), 7) AS DOUBLE) AS harmonic, round(power(100.0 + i, 0.5) / (0.5 * 0.02) * (power(100.0 + i, 0.5) - power((100.0 + i) / 1000, 0.5)), 5) AS eur_hyperbolic, round((100.0 + i) / 0.02, 6) AS eur_exponential, round((100.0 + i) / 0.02 * ln(10000), 5) AS eur_harmonic FROM range(0, 60) a(i)")
def decline_curve(spark, sf):
    d = spark.range(60).select(F.col("id").cast("int").alias("month"), (100.0 + F.col("id")).alias("q0"))
    return d.select("month", r(s.decline_hyperbolic("month", 100, 0.02, 0.5), 7).alias("hyperbolic"), r(s.decline_exponential("month", 100, 0.02), 7).alias("exponential"), r(s.decline_harmonic("month", 100, 0.02), 7).alias("harmonic"), r(s.recovery_hyperbolic("q0", 0.02, 0.5), 5).alias("eur_hyperbolic"), r(s.recovery_exponential("q0", 0.02)).alias("eur_exponential"), r(s.recovery_harmonic("q0", 0.02), 5).alias("eur_harmonic"))


@query("SELECT n_nationkey, chr(65 + n_nationkey) AS letter, 'T' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS label, substr(n_name, 1, 1) || upper(substr(n_name, 2, 1)) || substr(n_name, 3) AS upper2 FROM nation")
def label_text(spark, sf):
    n = t(spark, sf, "nation").withColumn("c", F.col("n_nationkey") + 1)
    return n.select("n_nationkey", s.cluster_letter("c", 25).alias("letter"), s.cluster_letter("c", 40).alias("label"), s.upper_at("n_name", 2).alias("upper2"))


@query("SELECT p_partkey, round(sqrt(power(least(p_size % 24, 24 - p_size % 24), 2) + 0.5 * power(least(CAST(p_partkey % 360 AS DOUBLE), 360 - p_partkey % 360), 2)), 6) AS d FROM part")
def periodic_distance(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(s.periodic_distance([F.col("p_size").cast("double"), F.col("p_partkey").cast("double")], [F.lit(0.0), F.lit(0.0)], [24.0, 360.0], [1.0, 0.5])).alias("d"))


@query("SELECT p_partkey, round(greatest(least(p_retailprice, 1800), 900), 4) AS clamped FROM part")
def contour_clamp(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(s.contour_level("p_retailprice", 900.0, 1800.0, 9_000_000), 4).alias("clamped"))


@query(f"WITH p AS (SELECT lon, lat, max(s_acctbal) AS z FROM {PLACES} GROUP BY 1, 2), b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p), g AS (SELECT i, j, x0 + i * (x1 - x0) / 4 AS gx, y0 + j * (y1 - y0) / 4 AS gy FROM range(0, 5) a(i), range(0, 5) c(j), b), d AS (SELECT i, j, z, power(lon - gx, 2) + power(lat - gy, 2) AS q FROM p, g) SELECT i, j, round(coalesce(avg(CASE WHEN q = 0 THEN z END), sum(CASE WHEN q > 0 THEN z / q END) / sum(CASE WHEN q > 0 THEN 1 / q END)), 4) AS value FROM d GROUP BY 1, 2")
def idw_grid(spark, sf):
    p = spatial.largest_at_point(places(spark, sf), "lon", "lat", "s_acctbal")
    return spatial.inverse_distance(p, spatial.grid_points(p, "lon", "lat", 5, 5), "lon", "lat", "s_acctbal").select("i", "j", r("value", 4).alias("value"))


@query(f"SELECT s_suppkey, lat < 37 AND lon < -96 AND lat - 32.993 > (lon + 105) * 0.1 AS inside FROM {PLACES}")
def point_in_polygon(spark, sf):
    corners = [(-200.0, 32.993 - 9.5), (-96.0, 32.993 + 0.9), (-96.0, 37.0), (-200.0, 37.0)]
    return places(spark, sf).select("s_suppkey", spatial.in_polygon("lon", "lat", corners).alias("inside"))


@query()
def convex_hull(spark, sf):
    return spatial.convex_hull(places(spark, sf), "lon", "lat")


@query(f"WITH p AS (SELECT * FROM {PLACES}), d AS (SELECT a.s_suppkey, min(sqrt(power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2))) AS d FROM p a JOIN p b ON a.s_suppkey <> b.s_suppkey GROUP BY 1) SELECT round(quantile_cont(d, 0.5), 8) AS spacing FROM d")
def nearest_spacing(spark, sf):
    return spatial.nearest_spacing(places(spark, sf), "lon", "lat", "s_suppkey", cells=16).select(r("spacing", 8).alias("spacing"))


@query()
def contour_map(spark, sf):
    return spatial.contour_map(places(spark, sf), "lon", "lat", "s_acctbal", 12)


# Clusters


@query("WITH n AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_type, CAST(row_number() OVER (ORDER BY n DESC, p_type) AS INTEGER) AS cluster FROM n) SELECT p_partkey, cluster FROM part p JOIN k ON p.p_type = k.p_type")
def cluster_relabel(spark, sf):
    return order.by_size(t(spark, sf, "part"), "p_type").select("p_partkey", "cluster")


@query("SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 7) AS mean, round(var_pop(CAST(embedding[i] AS DOUBLE)), 7) AS variance, count(*) AS n FROM embeddings, range(1, 65) a(i) GROUP BY 1, 2")
def cluster_stats(spark, sf):
    c = cluster.cluster_means(t(spark, sf, "embeddings"), "embedding", "label")
    return c.select("label", "n", F.posexplode(F.arrays_zip("mean", "variance")).alias("pos", "_z")).select("label", "pos", r("_z.mean", 7).alias("mean"), r("_z.variance", 7).alias("variance"), "n")


_E = "(SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) a(i))"


@query(f"WITH e AS {_E}, c AS (SELECT label, i, avg(x) AS mu FROM e GROUP BY 1, 2), d AS (SELECT e.label, vec_id, sum(power(x - mu, 2)) AS far FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1, 2) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY far, vec_id) AS r FROM d) WHERE r = 1")
def medoid(spark, sf):
    return cluster.medoids(t(spark, sf, "embeddings"), "embedding", "label", "vec_id")


@query(f"WITH e AS {_E}, u AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM e), s AS (SELECT label AS c, i, sum(u) AS s, count(*) AS n FROM u GROUP BY 1, 2), d AS (SELECT vec_id, label, c, max(n) AS n, max(n) - sum(u * s) AS d FROM u JOIN s ON u.i = s.i GROUP BY 1, 2, 3), ab AS (SELECT vec_id, label, max(CASE WHEN c = label AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN c <> label THEN d / n END) AS b FROM d GROUP BY 1, 2) SELECT vec_id, label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab")
def cosine_silhouette(spark, sf):
    return cluster.cosine_silhouettes(t(spark, sf, "embeddings"), "embedding", "label", "vec_id").select("vec_id", "label", r("silhouette").alias("silhouette"))


@query()
def kmeans_robust(spark, sf):
    return cluster.kmeans(t(spark, sf, "embeddings"), "embedding", "vec_id", 5, 2)[0].select("vec_id", "cluster")


@query()
def gmm_select(spark, sf):
    return cluster.gaussian_mixture(t(spark, sf, "embeddings"), "embedding", [2, 3], 1)[1].select("vec_id", "cluster")


@query()
def compress_rows(spark, sf):
    rows = user_types(spark, sf)
    return cluster.decompress_rows(cluster.compress_rows(rows, "x", "id", [2, 3, 4], 1), "id")


# Factorization


NAMES = ["click", "error", "purchase", "signup", "view"]


def user_types(spark, sf):
    """users x event types: (id, x)."""
    w = t(spark, sf, "events").groupBy(F.col("user_id").alias("id")).pivot("event_type", NAMES).agg(F.sum("value"))
    return fz.wide_to_rows(w, "id", NAMES)


@query()
def nmf_sweep(spark, sf):
    o = fz.Options(runs=10, max_iter=500)
    return fz.with_choice(fz.sweep(user_types(spark, sf), [2, 3, 4], o))


@query()
def nmf_ensemble_k(spark, sf):
    return fz.ensemble(user_types(spark, sf), [3], fz.Options(runs=6, max_iter=300)).select("k", "run", "fit")


@query()
def sparse_nmf(spark, sf):
    return fz.sweep(user_types(spark, sf), [2, 3], fz.Options(runs=4, method="sparse", max_iter=200)).select("k", "fit", "robustness", "aic")


@query()
def mixture_unmix(spark, sf):
    return fz.sweep(user_types(spark, sf), [2], fz.Options(runs=4, method="mixing", kernel={"iterations": 600})).select("k", "fit", "robustness", "aic")


@query()
def mapping_predict(spark, sf):
    _, x = fz.to_matrix(user_types(spark, sf))
    return fz.mapping(x[:, :3], x[:, 3:], user_types(spark, sf).select("id", F.slice("x", 1, 3).alias("x")))[1]


@query()
def fold_in_rows(spark, sf):
    _, x = fz.to_matrix(user_types(spark, sf))
    from ..operators import kernels

    return fz.fold_in(user_types(spark, sf), kernels.multiplicative(x, 3, 1, max_iter=300)[1])


@query()
def tall_factorization(spark, sf):
    return fz.factorize_tall(user_types(spark, sf), 2, 8)[0]


@query()
def progressive_windows(spark, sf):
    d = t(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("id")).pivot("event_type", NAMES).agg(F.sum("value"))
    return fz.progressive(fz.wide_to_rows(d, "id", NAMES), [10, 20], [2, 3], fz.Options(runs=3, max_iter=200))


@query()
def uncertainty_ranges(spark, sf):
    return fz.uncertainty(user_types(spark, sf), 2, 4, fz.Options(max_iter=200))


@query()
def tensor_sweep(spark, sf):
    return fz.tensor_sweep(cells3(spark, sf), ["a", "b", "c"], [2], fz.Options(runs=3, max_iter=200))


@query()
def postprocess(spark, sf):
    rows = user_types(spark, sf)
    found = fz.sweep(rows, [2], fz.Options(runs=4, max_iter=300)).cache()
    ids = rows.select("id").orderBy("id").collect()
    w_names = spark.createDataFrame([(i, str(x["id"])) for i, x in enumerate(ids)], "i int, name string")
    h_names = spark.createDataFrame(list(enumerate(NAMES)), "j int, name string")
    return post.report(found, 2, w_names, h_names).clusters


_RIDGE = "WITH a AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, var_pop(l_quantity) + 0.1 / count(*) AS xx, var_pop(l_discount) + 0.1 / count(*) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mz + (l_quantity - mx) * (xz * yy - yz * xy) / (xx * yy - xy * xy) + (l_discount - my) * (yz * xx - xz * xy) / (xx * yy - xy * xy), 2) AS estimate FROM lineitem, a"


@query(_RIDGE)
def ridge_predict(spark, sf):
    d = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    return fz.ridge_regression(d, d, ["l_quantity", "l_discount"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("estimate", 2).alias("estimate"))


_MU = """WITH x AS (SELECT user_id AS i, event_type AS j, sum(value) AS x FROM events GROUP BY 1, 2),
w AS (SELECT DISTINCT i, CAST(k AS INTEGER) AS k, ((i * 7919 + k * 104729) % 1000 + 1) / 1001.0 AS w FROM x, range(0, 2) a(k)),
h AS (SELECT DISTINCT j, CAST(k AS INTEGER) AS k, ((length(j) * 7919 + k * 104729) % 1000 + 1) / 1001.0 AS h FROM x, range(0, 2) a(k)),
v AS (SELECT i, j, sum(w * h) AS v FROM w JOIN h ON w.k = h.k GROUP BY 1, 2),
n AS (SELECT w.k, x.j, sum(w * x / v) AS n FROM x JOIN v ON x.i = v.i AND x.j = v.j JOIN w ON w.i = x.i GROUP BY 1, 2),
c AS (SELECT k, sum(w) AS c FROM w GROUP BY 1)
SELECT h.k, h.j, round(h * n / c, 6) AS h FROM h JOIN n ON h.k = n.k AND h.j = n.j JOIN c ON h.k = c.k"""


@query(_MU)
def mu_step_1(spark, sf):
    """One update of H from arithmetic factors, as joins and sums over cells."""
    x = t(spark, sf, "events").groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("j")).agg(F.sum("value").alias("x"))
    ks = spark.range(2).select(F.col("id").cast("int").alias("k"))
    start = lambda key: ((key * 7919 + F.col("k") * 104729) % 1000 + 1) / 1001.0
    w = x.select("i").distinct().crossJoin(F.broadcast(ks)).select("i", "k", start(F.col("i")).alias("w"))
    h = x.select("j").distinct().crossJoin(F.broadcast(ks)).select("j", "k", start(F.length("j")).alias("h"))
    v = rd.reconstruction(w, h)
    n = x.join(v, ["i", "j"]).join(w, "i").groupBy("k", "j").agg(F.sum(F.col("w") * F.col("x") / F.col("v")).alias("n"))
    c = w.groupBy("k").agg(F.sum("w").alias("c"))
    return h.join(n, ["k", "j"]).join(F.broadcast(c), "k").select("k", "j", r(F.col("h") * F.col("n") / F.col("c")).alias("h"))


@query("SELECT CAST(i % 5 AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(w * c * d) / sum(w * c), 6) AS delta FROM (SELECT i, k, ((i * 7919 + k * 104729) % 1000 + 1) / 1001.0 AS w FROM range(0, 5) a(i), range(0, 3) b(k)) w JOIN (SELECT k, j, ((j * 31 + k * 17) % 10 + 1) * 1.0 AS c, ((j * 13 + k * 7) % 9 - 4) * 1.0 AS d FROM range(0, 3) a(k), range(0, 2) b(j)) q ON w.k = q.k GROUP BY 1, 2")
def mixture_deltas(spark, sf):
    w = spark.range(15).select((F.col("id") % 5).cast("int").alias("i"), F.floor(F.col("id") / 5).cast("int").alias("k")).select("i", "k", (((F.col("i") * 7919 + F.col("k") * 104729) % 1000 + 1) / 1001.0).alias("w"))
    q = spark.range(6).select((F.col("id") % 2).cast("int").alias("j"), F.floor(F.col("id") / 2).cast("int").alias("k"))
    c = q.select("k", "j", ((F.col("j") * 31 + F.col("k") * 17) % 10 + 1.0).alias("c"))
    d = q.select("k", "j", ((F.col("j") * 13 + F.col("k") * 7) % 9 - 4.0).alias("d"))
    return rd.mixture_deltas(w, c, d).select("i", "j", r("delta").alias("delta"))


# Streams


@query("SELECT date_trunc('day', ts) AS start, event_type AS name, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1, 2")
def tumbling_matrix(spark, sf):
    from ..streaming.stream import tumbling_matrix

    return tumbling_matrix(t(spark, sf, "events"), "ts", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "name", r("total", 4).alias("total"), "n")
