"""Further queries: solvers on planted problems, whose answers SQL can state, and operators on the driver's tables.

A planted matrix is made from keys by arithmetic, so its signals, groups and products are known exactly. The queries give
facts that don't depend on the order of signals or on the path of a solver: the number of signals chosen, which rows go
together, predictions to a tolerance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import missing as m, scalar as s
from ..operators import cluster, encode, factorize as fz, profile, reduce as rd, spatial, transform as tr
from ..sources import store
from .catalog import GAPS, PLACES, places, query, r, t

#: W (60 x 3) and H (3 x 8) of the planted product: each signal has a column of H and rows of W of its own.
_WROW = "[CASE WHEN i % 3 = 0 THEN 5.0 + i % 7 ELSE ((i * 7) % 5) * CAST((i % 2) AS DOUBLE) END, CASE WHEN i % 3 = 1 THEN 4.0 + i % 5 ELSE ((i * 3) % 4) * CAST((i % 2) AS DOUBLE) END, CASE WHEN i % 3 = 2 THEN 6.0 + i % 4 ELSE 0.0 END]"


def planted(rows: int = 60) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(rows)
    w = np.stack([np.where(i % 3 == 0, 5.0 + i % 7, (i * 7) % 5 * (i % 2)), np.where(i % 3 == 1, 4.0 + i % 5, (i * 3) % 4 * (i % 2)), np.where(i % 3 == 2, 6.0 + i % 4, 0.0)], 1)
    h = np.array([[1, 0, 0, 0.5, 0.2, 0, 1, 0], [0, 1, 0, 0, 0.7, 0.4, 0, 1], [0, 0, 1, 0.3, 0, 0.9, 0.1, 0]], float)
    return w, h


def planted_rows(spark, rows: int = 60):
    w, h = planted(rows)
    return spark.createDataFrame([(i, x) for i, x in enumerate((w @ h).tolist())], "id long, x array<double>")


def _alike(found: np.ndarray, truth: np.ndarray) -> list[bool]:
    """For each true row, whether exactly one found row has the same direction."""
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    c = unit(np.array(found, float)) @ unit(truth).T
    return [bool((c[:, j] > 0.98).sum() == 1) for j in range(len(truth))]


def _signals(spark, found, k: int = 3):
    """(signal, recovered) of the solution with k signals."""
    best = found.where(F.col("k") == k).first()
    return spark.createDataFrame([(j, ok) for j, ok in enumerate(_alike(best["h"], planted()[1]))], "signal int, recovered boolean")


_THREE = "SELECT CAST(signal AS INTEGER) AS signal, true AS recovered FROM range(0, 3) a(signal)"


@query("SELECT CAST(k AS INTEGER) AS k, k = 3 AS chosen, k >= 3 AS exact FROM range(2, 5) a(k)")
def planted_choice(spark, sf):
    """The sweep chooses the planted number of signals; the product is met from that number on."""
    found = fz.with_choice(fz.sweep(planted_rows(spark), [2, 3, 4], fz.Options(runs=8, max_iter=4000, kernel={"small": 0.0})), 0.9)
    return found.select("k", "chosen", (F.col("fit") < 1.0).alias("exact"))


@query(_THREE)
def planted_signals(spark, sf):
    return _signals(spark, fz.sweep(planted_rows(spark), [3], fz.Options(runs=4, max_iter=6000, kernel={"small": 0.0})))


@query(_THREE)
def planted_squares(spark, sf):
    return _signals(spark, fz.sweep(planted_rows(spark), [3], fz.Options(runs=4, method="squares", max_iter=6000)))


@query(_THREE)
def planted_alternating(spark, sf):
    return _signals(spark, fz.sweep(planted_rows(spark), [3], fz.Options(runs=4, method="alternating")))


@query(_THREE)
def planted_sparse(spark, sf):
    return _signals(spark, fz.sweep(planted_rows(spark), [3], fz.Options(runs=6, method="sparse", max_iter=4000, kernel={"sparsity": 0.01})))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(j AS INTEGER) AS j, true AS near FROM range(0, 60) a(i), range(0, 8) b(j)")
def planted_tall(spark, sf):
    """The distributed factorization meets the product: every cell within a twentieth of the largest."""
    w, h, _ = fz.factorize_tall(planted_rows(spark), 3, 40, tol=1e-9)
    cols = F.array(*[F.aggregate(F.zip_with("w", F.array(*[F.lit(float(v)) for v in h[:, j]]), lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x) for j in range(h.shape[1])])
    got = w.select("id", F.posexplode(cols).alias("j", "e"))
    x = planted_rows(spark).select("id", F.posexplode("x").alias("j", "v"))
    return got.join(x, ["id", "j"]).select("id", "j", (F.abs(F.col("e") - F.col("v")) < 1.0).alias("near"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, true AS near FROM range(0, 30) a(i), range(0, 5) b(j)")
def planted_mixing(spark, sf):
    """Mixtures of three waters, some of them pure: shares sum to 1 and give the concentrations back."""
    i = np.arange(30)
    w = np.stack([i % 4, (i * 3) % 5, (i * 7) % 3], 1) + np.eye(3)[i % 3] * (i < 6)[:, None] * 100.0
    w = np.where((i < 3)[:, None], np.eye(3)[i % 3], w + 0.1)
    w = w / w.sum(axis=1, keepdims=True)
    h = np.array([[10, 1, 0, 5, 2], [0, 8, 3, 1, 9], [4, 0, 12, 2, 1]], float)
    x = w @ h
    rows = spark.createDataFrame([(int(q), v) for q, v in enumerate(x.tolist())], "id long, x array<double>")
    best = fz.sweep(rows, [3], fz.Options(runs=4, method="mixing", kernel={"iterations": 6000})).first()
    got = np.array(best["w"], float)
    near = (np.abs(got @ np.array(best["h"], float) - x) < 0.2) & (np.abs(got.sum(axis=1, keepdims=True) - 1) < 1e-6)
    return spark.createDataFrame([(a, b, bool(near[a, b])) for a in range(30) for b in range(5)], "i int, j int, near boolean")


@query("SELECT axis, CAST(k AS INTEGER) AS k, k >= 2 AS exact FROM (VALUES ('a'), ('b')) x(axis), range(1, 3) r(k)")
def planted_tensor(spark, sf):
    """An array of two outer products, unfolded along two of its axes: two signals are enough, one isn't."""
    u = [np.array([5, 1, 3, 2.0]), np.array([1, 4, 0, 2, 6.0]), np.array([2, 1, 3.0])]
    v = [np.array([1, 6, 0, 3.0]), np.array([5, 0, 3, 1, 1.0]), np.array([1, 4, 1.0])]
    x = np.einsum("i,j,k->ijk", *u) + np.einsum("i,j,k->ijk", *v)
    cells = spark.createDataFrame([(*map(int, at), float(q)) for at, q in np.ndenumerate(x) for at in [at]], "a int, b int, c int, v double")
    got = fz.tensor_sweep(cells, ["a", "b", "c"], [1, 2], fz.Options(runs=4, max_iter=6000, kernel={"small": 0.0}), ["a", "b"])
    return got.select("axis", "k", (F.col("fit") < 1.0).alias("exact"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, true AS ordered, true AS around FROM range(0, 60) a(i), range(0, 8) b(j)")
def planted_uncertainty(spark, sf):
    """Reruns on resampled data: ranges hold their order and lie near the planted product."""
    got = fz.uncertainty(planted_rows(spark), 3, 5, fz.Options(max_iter=3000))
    x = planted_rows(spark).select(F.col("id").cast("int").alias("i"), F.posexplode("x").alias("j", "v"))
    return got.join(x, ["i", "j"]).select("i", "j", ((F.col("least") <= F.col("largest")) & (F.col("variance") >= 0)).alias("ordered"), ((F.col("largest") > F.col("v") - 8) & (F.col("least") < F.col("v") + 8)).alias("around"))


@query("SELECT CAST(w AS INTEGER) AS \"window\", true AS window_exact, true AS all_exact FROM (VALUES (24), (48)) x(w)")
def planted_progress(spark, sf):
    """Signals learned on the first rows describe all rows."""
    got = fz.progressive(planted_rows(spark), [24, 48], [3], fz.Options(runs=4, max_iter=6000, kernel={"small": 0.0}))
    return got.select("window", (F.col("fit_window") < 1.0).alias("window_exact"), (F.col("fit_all") < 3.0).alias("all_exact"))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(j AS INTEGER) AS j, true AS near FROM range(0, 60) a(i), range(0, 4) b(j)")
def planted_mapping(spark, sf):
    """Y = X H is learned from even rows and predicts all: within a thousandth of the truth."""
    w, _ = planted()
    x = np.concatenate([w, w[:, :1] * 0.5 + w[:, 1:2]], 1) + 0.1
    h = np.array([[1, 0, 0.3, 0], [0, 2, 0, 0.5], [0.4, 0, 1, 0], [0, 0.1, 0, 1]])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    got = fz.mapping(x[::2], (x @ h)[::2], rows)[1].select("id", F.posexplode("y").alias("j", "v"))
    truth = spark.createDataFrame([(i, j, float(v)) for i, q in enumerate(x @ h) for j, v in enumerate(q)], "id long, j int, truth double")
    return got.join(truth, ["id", "j"]).select("id", "j", (F.abs(F.col("v") - F.col("truth")) < 1e-2 * (1 + F.col("truth"))).alias("near"))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(k AS INTEGER) AS k, round(x, 4) AS w FROM (SELECT i, " + _WROW + " AS w FROM range(0, 60) a(i)), range(0, 3) b(k), LATERAL (SELECT w[k + 1] AS x)")
def planted_fold_in(spark, sf):
    """With the planted H fixed each row's weights are the planted ones."""
    got = fz.fold_in(planted_rows(spark), planted()[1]).select("id", F.posexplode("w").alias("k", "w"))
    return got.select("id", "k", F.abs(r("w", 4)).alias("w"))


_SPREAD = "SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS g FROM embeddings"
_GROUPS = f"WITH p AS ({_SPREAD}), n AS (SELECT g, count(*) AS n, min(vec_id) AS f FROM p GROUP BY 1), k AS (SELECT g, n FROM n) SELECT p.vec_id, CAST(k.n AS BIGINT) AS members FROM p JOIN k ON p.g = k.g"


def spread(spark, sf):
    """The embeddings moved far apart by vec_id % 3: three groups that any method must find."""
    e = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 3 == F.col("vec_id") % 3, 40.0).otherwise(0.0)).alias("v"))
    return e


def _with_members(rows):
    """(vec_id, members): how many rows share the row's cluster; one cluster must be one planted group."""
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("vec_id") % 3).alias("kinds"))
    return rows.join(sizes, "cluster").select("vec_id", F.when(F.col("kinds") == 1, F.col("n")).alias("members"))


@query(_GROUPS)
def planted_kmeans(spark, sf):
    return _with_members(cluster.kmeans(spread(spark, sf), "v", "vec_id", 3, 3)[0])


@query(_GROUPS)
def planted_kmeans_k(spark, sf):
    """The number of clusters is found too."""
    return _with_members(cluster.kmeans_range(spread(spark, sf), "v", "vec_id", [2, 3], 2)[1])


@query(_GROUPS)
def planted_mixture_model(spark, sf):
    few = spread(spark, sf).select("vec_id", F.array(*[sum((F.col("v")[i] for i in range(q, 64, 3)), F.lit(0.0)) for q in range(3)]).alias("v"))
    return _with_members(cluster.gaussian_mixture(few, "v", [2, 3], 1)[1])


@query("WITH p AS (SELECT vec_id, vec_id % 3 AS g FROM embeddings WHERE vec_id % 50 <> 7), n AS (SELECT g, count(*) AS n FROM p GROUP BY 1) SELECT vec_id, CAST(n AS BIGINT) AS members FROM p JOIN n ON p.g = n.g UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 50 = 7")
def planted_compression(spark, sf):
    """Rows with a missing value are imputed, rows without any are cluster 0."""
    holes = F.transform("v", lambda x, i: F.when((F.col("vec_id") % 50 == 7) | (F.col("vec_id") % 10 == 3) & (i == 5), F.lit(None)).otherwise(x))
    rows = spread(spark, sf).withColumn("v", holes)
    labels = cluster.compress_rows(rows, "v", "vec_id", [2, 3, 4], 1).labels
    some = _with_members(labels.where("cluster > 0"))
    return some.unionByName(labels.where("cluster = 0").select("vec_id", F.lit(None).cast("long").alias("members")))


_FIT = "WITH a AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, count(*) AS n, var_pop(l_quantity) + {r} / count(*) AS xx, var_pop(l_discount) + {r} / count(*) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz FROM lineitem), b AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS \"by\" FROM a)"


@query(_FIT.format(r=0.1) + ' SELECT round(bx, 3) AS a, round("by", 1) AS b, round(mz - bx * mx - "by" * my, 1) AS c FROM b')
def ridge_coefficients(spark, sf):
    """The plane through three estimates gives the coefficients, which the normal equations state."""
    d = t(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    ask = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "l_quantity double, l_discount double")
    got = fz.ridge_regression(d, ask, ["l_quantity", "l_discount"], "l_extendedprice")
    at = lambda x, y: F.max(F.when((F.col("l_quantity") == x) & (F.col("l_discount") == y), F.col("estimate")))
    return got.agg(at(0, 0).alias("o"), at(1, 0).alias("x"), at(0, 1).alias("y")).select(r(F.col("x") - F.col("o"), 3).alias("a"), r(F.col("y") - F.col("o"), 1).alias("b"), r(F.col("o"), 1).alias("c"))


# Scalings and their inverses


@query("WITH s AS (SELECT *, least(l_quantity, l_discount, l_tax) AS lo, greatest(l_quantity, l_discount, l_tax) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 9) AS scaled, round(l_discount, 9) AS back FROM s")
def row_ranges_undone(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    d = t(spark, sf, "lineitem").withColumns({"lo": F.least(*cols), "hi": F.greatest(*cols)})
    n = tr.minmax_rows(d, cols).withColumn("scaled", F.col("l_discount"))
    return tr.denormalize_rows(n, cols, "lo", "hi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("scaled", 9).alias("scaled"), r("l_discount", 9).alias("back"))


_SLICES = "(SELECT l_suppkey % 5 AS a, l_linenumber AS b, l_partkey % 7 AS c, sum(q) AS v FROM " + GAPS + " GROUP BY 1, 2, 3)"


def slices(spark, sf):
    from .catalog import gaps

    return gaps(spark, sf).groupBy((F.col("l_suppkey") % 5).alias("a"), F.col("l_linenumber").alias("b"), (F.col("l_partkey") % 7).alias("c")).agg(m.sum_("q").alias("v"))


@query(f"WITH c AS {_SLICES}, g AS (SELECT a, min(v) AS lo, max(v) AS hi FROM c GROUP BY 1) SELECT c.a, b, c.c, round((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 8) AS scaled, round((hi - v) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 8) AS turned, round(v, 5) AS back FROM c JOIN g ON c.a = g.a")
def slice_ranges_undone(spark, sf):
    c = slices(spark, sf)
    g = tr.slice_ranges(c, ["a"])
    n = tr.minmax_cells(c, g, ["a"])
    turned = tr.minmax_cells(c, g, ["a"], reverse=True).withColumnRenamed("v", "turned")
    back = tr.denormalize_cells(n, g, ["a"]).withColumnRenamed("v", "back")
    return n.join(turned, ["a", "b", "c"]).join(back, ["a", "b", "c"]).select("a", "b", "c", r("v", 8).alias("scaled"), r("turned", 8).alias("turned"), r("back", 5).alias("back"))


@query(f"WITH c AS {_SLICES}, g AS (SELECT b, max(v) AS hi FROM c GROUP BY 1) SELECT a, c.b, c.c, round(v / hi, 8) AS scaled, round(v, 5) AS back FROM c JOIN g ON c.b = g.b")
def slice_tops_undone(spark, sf):
    c = slices(spark, sf)
    tops = c.groupBy("b").agg(m.largest("v").alias("top"))
    n = tr.over_largest(c, ["v"], by=["b"]).select("a", "b", "c", "v")
    back = tr.descale_cells(n, tops, ["b"]).withColumnRenamed("v", "back")
    return n.join(back, ["a", "b", "c"]).select("a", "b", "c", r("v", 8).alias("scaled"), r("back", 5).alias("back"))


@query("WITH s AS (SELECT *, greatest(l_quantity, l_discount, l_tax) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount / hi, 9) AS scaled, round(l_discount, 9) AS back, round(l_tax / (SELECT max(l_tax) FROM lineitem), 9) AS by_column FROM s")
def row_tops_undone(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    d = t(spark, sf, "lineitem").withColumns({"hi": F.greatest(*cols), "by_column": F.col("l_tax")})
    n = tr.over_largest_in_row(tr.over_largest(d, ["by_column"]), cols).withColumn("scaled", F.col("l_discount"))
    return tr.descale_rows(n, cols, "hi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("scaled", 9).alias("scaled"), r("l_discount", 9).alias("back"), r("by_column", 9).alias("by_column"))


@query("SELECT c_custkey, round(log10(abs(v)), 8) AS sizes, round(CASE WHEN c_acctbal > 0 THEN log10(CASE WHEN c_acctbal > 0 THEN c_acctbal END) ELSE lo - 2 END, 8) AS mixed FROM (SELECT *, -abs(c_acctbal) - 1 AS v FROM customer), (SELECT min(log10(c_acctbal)) AS lo FROM customer WHERE c_acctbal > 0)")
def log10_of_sizes(spark, sf):
    """Without a positive value the logs are those of the sizes; with some, the others go under the smallest log."""
    d = t(spark, sf, "customer").withColumns({"sizes": -F.abs("c_acctbal") - 1, "mixed": F.col("c_acctbal")})
    return tr.log10_safe(tr.log10_safe(d, "sizes"), "mixed", 2.0).select("c_custkey", r("sizes", 8).alias("sizes"), r("mixed", 8).alias("mixed"))


@query("SELECT c_custkey, greatest(c_acctbal, 0.5) AS c_acctbal FROM customer")
def floor_at(spark, sf):
    return tr.floor_at(t(spark, sf, "customer"), ["c_acctbal"], 0.5).select("c_custkey", "c_acctbal")


# Masks, text, labels


@query("SELECT DISTINCT l_suppkey AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM lineitem, range(0, 3) a(j), range(0, 2) b(k) WHERE l_discount > 0.09")
def mask_repeated(spark, sf):
    mask = t(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_suppkey").alias("i")).distinct()
    return tr.repeat_mask(mask, {"j": 3, "k": 2})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 1 + 7 * (l_suppkey % 3) AS \"row\", 'line ' || (l_linenumber - 1) || ' s ' || (l_suppkey % 3) AS row_label, 3 * (l_linenumber - 1) + l_suppkey % 3 AS other FROM lineitem")
def flat_places(spark, sf):
    d = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") - 1).alias("n"), (F.col("l_suppkey") % 3).alias("s"))
    d = tr.flat_index(tr.flat_index(d, {"n": 7, "s": 3}, labels={"n": "line"}), {"n": 7, "s": 3}, first_fastest=False, to="other")
    return d.drop("n", "s")


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_nationkey AS VARCHAR) END, 'missing') AS nation, s_suppkey % 4 = 0 AS gone, printf('%05d/%.2f', s_suppkey, s_acctbal) AS shown FROM supplier")
def text_forms(spark, sf):
    d = t(spark, sf, "supplier").withColumn("n", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey")))
    return d.select("s_suppkey", tr.text_or_missing("n").alias("nation"), m.is_missing("n").alias("gone"), s.formatted("%05d/%.2f", "s_suppkey", "s_acctbal").alias("shown"))


_CUT = "CASE WHEN contains({x}, '.') THEN regexp_replace(regexp_replace({x}, '0+$', ''), '\\.$', '') ELSE {x} END"


@query("WITH v AS (SELECT p_partkey, (p_retailprice + 0.01) / 8 AS v FROM part), f AS (SELECT *, printf('%.6f', v) AS d, split_part(printf('%.4e', v), 'e', 1) AS a, CAST(CAST(split_part(printf('%.4e', v), 'e', 2) AS INTEGER) AS VARCHAR) AS e FROM v) SELECT p_partkey, " + _CUT.format(x="d") + " AS plain, " + _CUT.format(x="a") + " || 'e' || e AS power FROM f")
def tick_labels(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", ((F.col("p_retailprice") + 0.01) / 8).alias("v"))
    small = s.tick_labels(d, "v", "plain")
    large = s.tick_labels(d.union(spark.createDataFrame([(-1, 1e6)], "p_partkey long, v double")), "v", "power").where("p_partkey >= 0").select("p_partkey", "power")
    return small.join(large, "p_partkey").select("p_partkey", "plain", "power")


@query("SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS few, 'gray' AS many FROM supplier")
def type_colors(spark, sf):
    d = t(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("k"))
    return encode.type_colors(encode.type_colors(d, "k", ["red", "green", "blue"], to="few"), "s_suppkey", ["red"], to="many").drop("k")


# Checks


@query("WITH c AS (SELECT user_id, dayofmonth(ts) AS d, sum(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, min(CASE WHEN v > 50 THEN d END) AS first, max(CASE WHEN v > 50 THEN d END) AS last, max(CASE WHEN v > 50 THEN d END) - min(CASE WHEN v > 50 THEN d END) + 1 AS length FROM c GROUP BY 1")
def record_range(spark, sf):
    c = t(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.sum("value").alias("v"))
    return profile.record_range(c, "user_id", "d", F.col("v") > 50).select("user_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "length")])


@query("WITH c AS (SELECT l_suppkey, l_partkey % 20 AS o, count(CASE WHEN l_tax > 0.07 THEN 1 END) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY l_suppkey ORDER BY o), 0) AS b FROM c) SELECT l_suppkey, bool_or(n > 0 AND b > 0) AS dense FROM p GROUP BY 1")
def dense_bins(spark, sf):
    c = t(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 20).alias("o")).agg(F.count_if(F.col("l_tax") > 0.07).alias("n"))
    return profile.rectangular(c, "l_suppkey", "o")


@query("WITH c AS (SELECT l_linenumber - 1 AS a, l_suppkey % 9 AS b, max(CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 1 END) AS v FROM lineitem WHERE l_suppkey % 9 < 8 GROUP BY 1, 2), n AS (SELECT 'a' AS axis, a AS place, count(v) AS n FROM c GROUP BY 2 UNION ALL SELECT 'b', b, count(v) FROM c GROUP BY 2), p AS (SELECT 'a' AS axis, i AS place FROM range(0, 8) x(i) UNION ALL SELECT 'b', i FROM range(0, 9) x(i)) SELECT p.axis, CAST(p.place AS BIGINT) AS place, coalesce(n, 0) <= 5 AS masked FROM p LEFT JOIN n ON p.axis = n.axis AND p.place = n.place")
def slice_masks(spark, sf):
    d = t(spark, sf, "lineitem").where("l_suppkey % 9 < 8").groupBy((F.col("l_linenumber") - 1).alias("a"), (F.col("l_suppkey") % 9).alias("b"))
    c = d.agg(F.max(F.when((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07), 1.0)).alias("v"))
    return profile.slice_masks(c, ["a", "b"], {"a": 8, "b": 9}, cutoff=5)


@query("SELECT s_suppkey, round(s_acctbal, 4) AS bal, gone FROM supplier, (SELECT 'half=same;lots=zeros;name=text;one=constant;twice=correlated' AS gone) WHERE s_suppkey % 5 > 0")
def matrix_robust(spark, sf):
    """Every fifth row is empty; four columns say nothing new, one is text."""
    some = F.col("s_suppkey") % 5 > 0
    d = t(spark, sf, "supplier").select("s_suppkey", F.when(some, F.col("s_acctbal")).alias("bal"), F.when(some, F.col("s_acctbal")).alias("half"), F.when(some, F.col("s_acctbal") * 2 + 1).alias("twice"), F.when(some, 0.0).alias("lots"), F.when(some, 3.5).alias("one"), F.when(some, F.col("s_name")).alias("name"))
    rows, gone = profile.robust_matrix(d, ["bal", "half", "twice", "lots", "one", "name"])
    return rows.select("s_suppkey", r("bal", 4).alias("bal"), F.lit(";".join(f"{c}={why}" for c, why in sorted(gone))).alias("gone"))


# Signals


@query("SELECT label, CAST(label % 3 AS BIGINT) AS signal FROM range(0, 3) a(label)")
def signal_assignments(spark, sf):
    """Parts of label p_size % 3 stand out in the signal of the same number."""
    d = t(spark, sf, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 3).cast("long").alias("label"))
    x = d.crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "k"))).select("name", "k", F.when(F.col("k") == F.col("label"), F.col("name") % 5 + 3.0).otherwise(F.col("name") % 4 * 0.5).alias("v"))
    got = cluster.signal_assignments(x, d)
    return spark.createDataFrame([(int(a), int(b)) for a, b in got.items()], "label long, signal long")


@query(f"WITH w AS (SELECT i, k, x FROM (SELECT i, {_WROW} AS w FROM range(0, 60) a(i)), range(0, 3) b(k), LATERAL (SELECT w[k + 1] AS x)), t AS (SELECT k, max(x) AS t FROM w GROUP BY 1) SELECT CAST(i AS INTEGER) AS i, CAST(w.k AS INTEGER) AS k, round(x / t, 9) AS w FROM w JOIN t ON w.k = t.k")
def factors_rescaled(spark, sf):
    w, h = fz.rescaled(*planted())
    if not np.allclose(w @ h, np.matmul(*planted())):
        raise ValueError("the product has changed")
    return spark.createDataFrame([(i, k, round(float(v), 9)) for i, q in enumerate(w) for k, v in enumerate(q)], "i int, k int, w double")


_MU = """WITH x AS (SELECT user_id AS i, event_type AS j, sum(value) AS x FROM events GROUP BY 1, 2),
w AS (SELECT DISTINCT i, CAST(k AS INTEGER) AS k, ((i * 7919 + k * 104729) % 1000 + 1) / 1001.0 AS w FROM x, range(0, 2) a(k)),
h AS (SELECT DISTINCT j, CAST(k AS INTEGER) AS k, ((length(j) * 7919 + k * 104729) % 1000 + 1) / 1001.0 AS h FROM x, range(0, 2) a(k)),
v AS (SELECT i, j, sum(w * h) AS v FROM w JOIN h ON w.k = h.k GROUP BY 1, 2),
n AS (SELECT w.k, v.j, sum(w * coalesce(x, v) / v) AS n FROM v LEFT JOIN x ON x.i = v.i AND x.j = v.j JOIN w ON w.i = v.i GROUP BY 1, 2),
c AS (SELECT k, sum(w) AS c FROM w GROUP BY 1)
SELECT h.k, h.j, round(h * n / c, 6) AS h FROM h JOIN n ON h.k = n.k AND h.j = n.j JOIN c ON h.k = c.k"""


@query(_MU)
def kernel_step(spark, sf):
    """One divergence update of H by the kernel itself; missing cells count as the product."""
    from ..operators import kernels as K
    from .catalog import NAMES, user_types

    ids, x = fz.to_matrix(user_types(spark, sf))
    start = lambda key, k: ((key * 7919 + k * 104729) % 1000 + 1) / 1001.0
    w = np.array([[start(i, k) for k in range(2)] for i in ids])
    h = np.array([[start(len(j), k) for j in NAMES] for k in range(2)])
    got = K.multiplicative(x, 2, w=w, h=h, fix_w=True, max_iter=1)[1]
    return spark.createDataFrame([(k, j, float(got[k, c])) for k in range(2) for c, j in enumerate(NAMES)], "k int, j string, h double").select("k", "j", r("h").alias("h"))


@query("WITH d AS (SELECT p_retailprice AS x, avg(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS e FROM part) SELECT round(avg(abs(x - e)), 5) AS mae, round(sqrt(avg(power(x - e, 2))), 5) AS rmse, round(max(abs(x - e)), 5) AS largest, round(1 - sum(power(x - e, 2)) / sum(power(x - (SELECT avg(x) FROM d), 2)), 7) AS r2, count(*) AS n FROM d")
def compression_error(spark, sf):
    p = t(spark, sf, "part")
    e = p.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("e"))
    got = rd.compression_error(p.join(e, ["p_brand", "p_type"]), "p_retailprice", "e")
    return got.select(r("mae", 5).alias("mae"), r("rmse", 5).alias("rmse"), r("largest", 5).alias("largest"), r("r2", 7).alias("r2"), "n")


# Space


@query("SELECT p_partkey, round(900 + round_even((least(greatest(p_retailprice, 900), 1800) - 900) / 112.5, 0) * 112.5, 6) AS level FROM part")
def contour_levels(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(s.contour_level("p_retailprice", 900.0, 1800.0, 8)).alias("level"))


_KN, _KA, _KF, _, _ = s._krueger()
_KE = 2 * _KN**0.5 / (1 + _KN)
_UTM = f"WITH p AS (SELECT s_suppkey, radians(lat) AS la, radians(lon - (CAST(floor((lon + 180) / 6) + 1 AS INTEGER) * 6 - 183)) AS d FROM {PLACES}), q AS (SELECT *, sinh(atanh(sin(la)) - {_KE!r} * atanh({_KE!r} * sin(la))) AS t FROM p), z AS (SELECT s_suppkey, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM q) SELECT s_suppkey, round(500000 + {0.9996 * _KA!r} * (eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_KF, 1)) + f"), 3) AS x, round({0.9996 * _KA!r} * (xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_KF, 1)) + "), 3) AS y FROM z"


@query(_UTM)
def utm_forward(spark, sf):
    d = places(spark, sf).withColumn("zone", s.utm_zone("lon"))
    x, y = s.utm("lat", "lon", "zone")
    return d.select("s_suppkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(f"WITH p AS (SELECT DISTINCT lon, lat FROM {PLACES}), g AS (SELECT greatest(max(lon) - min(lon), max(lat) - min(lat)) AS r FROM p), z AS (SELECT CASE WHEN r <= 6.144 THEN 6 + (6.144 - r) / 3.072 ELSE 6 - (r - 6.144) / 5.7344 END AS zoom FROM g), n AS (SELECT min(sqrt(power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2))) AS d FROM p a JOIN p b ON a.lon <> b.lon OR a.lat <> b.lat GROUP BY a.lon, a.lat) SELECT round(zoom, 6) AS zoom, 3 + ceil((SELECT avg(d) FROM n) * zoom * zoom * zoom) / 2 AS dot FROM z WHERE (SELECT r FROM g) BETWEEN 3.072 AND 11.8784")
def zoom_and_dot(spark, sf):
    d = places(spark, sf)
    zoom = spatial.zoom_level(d, "lon", "lat")
    return spark.createDataFrame([(round(zoom, 6), spatial.dot_size(d, "lon", "lat", zoom))], "zoom double, dot double")


@query("WITH b AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part), e AS (SELECT a, b, power(10, floor(log10(b - a))) AS p, (b - a) / power(10, floor(log10(b - a))) AS f FROM b), g AS (SELECT a, b, (CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 5 THEN 5 ELSE 10 END) * p / 4 AS s FROM e), h AS (SELECT a, b, s, power(10, floor(log10(s))) AS p FROM g), k AS (SELECT a, b, (CASE WHEN s / p < 1.5 THEN 1 WHEN s / p < 3 THEN 2 WHEN s / p < 7 THEN 5 ELSE 10 END) * p AS s FROM h) SELECT round(floor(a / s) * s, 6) AS low, round(ceil(b / s) * s, 6) AS high, CAST(950.5 AS DOUBLE) AS kept_low FROM k")
def color_bounds(spark, sf):
    d = t(spark, sf, "part")
    low, high = spatial.color_bounds(d, "p_retailprice")
    kept, _ = spatial.color_bounds(d, "p_retailprice", low=950.5)
    return spark.createDataFrame([(round(low, 6), round(high, 6), kept)], "low double, high double, kept_low double")


@query(f"WITH p AS (SELECT DISTINCT lon AS x, lat AS y FROM {PLACES}), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\" FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y), s AS (SELECT ax, ay, bx, \"by\", min((bx - ax) * (y - ay) - (\"by\" - ay) * (x - ax)) AS turn, max(CASE WHEN abs((bx - ax) * (y - ay) - (\"by\" - ay) * (x - ax)) < 1e-9 THEN power(x - ax, 2) + power(y - ay, 2) ELSE 0 END) AS far FROM e, p GROUP BY 1, 2, 3, 4) SELECT DISTINCT round(ax, 6) AS x, round(ay, 6) AS y FROM s WHERE turn > -1e-9 AND power(bx - ax, 2) + power(\"by\" - ay, 2) >= far - 1e-9 AND NOT EXISTS (SELECT 1 FROM e l JOIN e m ON l.ax = m.ax AND l.ay = m.ay WHERE l.ax = s.ax AND l.ay = s.ay AND abs((l.bx - l.ax) * (m.\"by\" - m.ay) - (l.\"by\" - l.ay) * (m.bx - m.ax)) < 1e-9 AND (l.bx - l.ax) * (m.bx - m.ax) + (l.\"by\" - l.ay) * (m.\"by\" - m.ay) < 0 AND l.bx = s.bx AND l.\"by\" = s.\"by\")")
def hull_corners(spark, sf):
    """The corners alone: points with all others on one side of a line to another, and not between two of them."""
    got = spatial.convex_hull(places(spark, sf), "lon", "lat")
    return got.select(r("x").alias("x"), r("y").alias("y"))


# Sampling and storage


@query("SELECT CAST(q AS INTEGER) AS axis, CAST(i AS BIGINT) AS stratum, CAST(1 AS BIGINT) AS n FROM range(0, 2) a(q), range(0, 50) b(i)")
def hypercube_strata(spark, sf):
    """Every stratum of either axis holds one point."""
    p = s.latin_hypercube_points(spark, 50, [10.0, 20.0])
    at = lambda c, b: F.floor((F.col(c) - 1.0) / (b - 1.0) * 50)
    both = p.select(F.lit(0).alias("axis"), at("p0", 10.0).alias("stratum")).union(p.select(F.lit(1), at("p1", 20.0)))
    return both.groupBy("axis", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT true AS same, true AS other, CAST(64 AS INTEGER) AS digits")
def content_key(spark, sf):
    """The key of rows in another order and partitioning is the same, that of other rows isn't."""
    d = t(spark, sf, "supplier")
    key = store.content_key(d)
    again, changed = store.content_key(d.repartition(5).orderBy(F.desc("s_acctbal"))), store.content_key(d.withColumn("s_acctbal", F.col("s_acctbal") + (F.col("s_suppkey") == 1).cast("double")))
    return spark.createDataFrame([(key == again, key != changed, len(key))], "same boolean, other boolean, digits int")


# Further forms


@query("WITH c AS (SELECT user_id % 4 AS a, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS b, dayofmonth(ts) % 3 AS c, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3) SELECT CAST(a + c * 4 AS BIGINT) AS \"row\", CAST(b AS INTEGER) AS col, v FROM c WHERE NOT (a = 1 AND c = 2)")
def flatten_masked(spark, sf):
    from .catalog import cells3

    mask = spark.createDataFrame([(1, 2)], "a int, c int")
    return tr.unfold(cells3(spark, sf), ["a", "b", "c"], "b", mask=mask)


@query("WITH e AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders) SELECT CAST(i + 1 AS INTEGER) AS bin, CAST(a + CAST(floor(CAST(date_diff('day', a, b) AS DOUBLE) * (2 * i + 1) / 10.0) AS INTEGER) AS DATE) AS centre FROM e, range(0, 5) r(i)")
def bin_dates(spark, sf):
    from ..operators import binning

    d = t(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return binning.bin_centres(d, "o_orderdate", 5).select(F.col("bin").cast("int").alias("bin"), "centre")


@query("WITH c AS (SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT id, min(m) AS a FROM c WHERE v > 0 GROUP BY 1) SELECT c.id, CAST(date_diff('month', a, m) + 1 AS INTEGER) AS place, round(v, 2) AS v FROM c JOIN s ON c.id = s.id WHERE m >= a AND date_diff('month', a, m) < 12")
def shifted_record(spark, sf):
    from ..operators import pivot

    return pivot.shifted_matrix(t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", record=12).select("id", "place", r("v", 2).alias("v"))


@query("SELECT l_suppkey % 10 AS k, l_linenumber % 2 AS block, round(sum(l_quantity * l_tax), 4) AS value FROM lineitem GROUP BY 1, 2")
def decode_blocks(spark, sf):
    codes = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("k"), (F.col("l_linenumber") % 2).alias("block"), F.col("l_quantity").alias("code"), "l_tax")
    return encode.decode_blocks(codes, "k", "block", "l_tax").select("k", "block", r("value", 4).alias("value"))


@query("WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey % 2 AS DOUBLE) END AS b, CASE WHEN c_custkey % 15 > 0 THEN CAST(c_custkey % 2 AS DOUBLE) END AS c FROM customer) SELECT c_custkey, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS INTEGER) AS n, a IS NULL AND b IS NULL AND c IS NULL AS missing, coalesce(a < 0, false) AS negative, coalesce(least(a, b, c) = greatest(a, b, c), false) AS constant FROM v")
def row_profile(spark, sf):
    k = F.col("c_custkey")
    d = t(spark, sf, "customer").select("c_custkey", F.when(k % 5 > 0, F.col("c_acctbal")).alias("a"), F.when(k % 3 > 0, (F.col("c_nationkey") % 2).cast("double")).alias("b"), F.when(k % 15 > 0, (k % 2).cast("double")).alias("c"))
    return profile.row_profile(d, "c_custkey", ["a", "b", "c"]).select("c_custkey", "n", "missing", "negative", "constant")


@query(f"WITH p AS (SELECT DISTINCT lon, lat FROM {PLACES}), b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p), g AS (SELECT i, j, x0 + i * (x1 - x0) / 19 AS gx, y0 + j * (y1 - y0) / 19 AS gy FROM b, range(0, 20) a(i), range(0, 20) c(j)) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM g WHERE EXISTS (SELECT 1 FROM p WHERE power(gx - lon, 2) + power(gy - lat, 2) <= 0.16)")
def tiles_in_reach(spark, sf):
    d = places(spark, sf)
    return spatial.within_reach(spatial.grid_points(d, "lon", "lat", 20, 20), d, "lon", "lat", 0.4).select("i", "j")


@query("SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(height AS DOUBLE) AS height, CAST(size AS INTEGER) AS size FROM (VALUES (0, 1, 0.0, 2), (2, 3, 0.0, 2), (5, 6, 0.292893, 4), (4, 7, 2.0, 5)) x(a, b, height, size)")
def complete_linkage(spark, sf):
    """Five directions: two pairs, 45 degrees apart, and their opposite."""
    ties = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 3.0]), (4, [-1.0, 0.0])]
    got = cluster.linkage(spark.createDataFrame(ties, "id int, v array<double>"), "v", "id")
    return spark.createDataFrame([(a, b, abs(round(h, 6)), n) for a, b, h, n in got], "a int, b int, height double, size int")


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE j WHEN 0 THEN w * -80 + (1 - w) * -40 ELSE w * -11 + (1 - w) * -5 END, 2) AS delta FROM (SELECT i, (i % 11) / 10.0 AS w FROM range(0, 22) a(i)), range(0, 2) b(j)")
def water_mixtures(spark, sf):
    """Two waters and their mixtures: the model gives the observed deltas back."""
    from ..operators import kernels as K

    share = (np.arange(22) % 11) / 10
    y = np.outer(share, [-80.0, -11.0]) + np.outer(1 - share, [-40.0, -5.0])
    w, d, fit = K.water_deltas(y, 2, seed=3)
    return spark.createDataFrame([(i, j, float(v)) for i, q in enumerate(w @ d) for j, v in enumerate(q)], "i int, j int, delta double").select("i", "j", r("delta", 2).alias("delta"))


@query("SELECT id, CAST(place AS INTEGER) AS place, true AS near FROM (SELECT CAST(i AS INTEGER) AS id, least(20, 24 - 3 * (i % 5)) AS n FROM range(0, 15) a(i)), LATERAL (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS place)")
def planted_forecast(spark, sf):
    """Wells of two kinds that began in different months: the later months of the young follow those of the old."""
    shapes = [[100.0 * 0.8**p + 2 for p in range(24)], [60.0 / (1 + 0.3 * p) for p in range(24)]]
    rows = [(i, f"20{10 + (m := 3 * (i % 5) + p) // 12}-{m % 12 + 1:02d}-01", (1 + i % 4) * shapes[0][p] * (i % 3 != 1) + (2 + i % 5) * shapes[1][p] * (i % 3 != 0)) for i in range(15) for p in range(min(20, 24 - 3 * (i % 5)))]
    d = spark.createDataFrame(rows, "well int, month string, gas double").withColumn("month", F.to_date("month"))
    got = fz.forecast(d, "well", "month", "gas", "2011-08-01", [2], fz.Options(runs=4, max_iter=6000, kernel={"small": 0.0}))
    return got.select("id", "place", (F.abs(F.col("estimate") - F.col("v")) < 0.05 * F.col("v") + 1).alias("near"))


@query("SELECT * FROM (VALUES ('H', 'click', 0), ('H', 'error', 0), ('H', 'view', 0)) x(side, name, signal) WHERE false UNION ALL SELECT side, name, signal FROM (SELECT 'H' AS side, 'c' || j AS name, CAST(0 AS INTEGER) AS signal FROM range(0, 4) a(j) UNION ALL SELECT 'W', 'r' || i, 0 FROM range(0, 3) b(i))")
def one_signal_report(spark, sf):
    """One signal, options as a bundle: all names belong to it."""
    from ..operators import post

    found = spark.createDataFrame([(1, 0.0, 1.0, 0.0, [[1.0], [2.0], [3.0]], [[1.0, 2.0, 3.0, 4.0]], [1.0], 1)], fz.SOLUTION)
    w_names = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "i int, name string")
    h_names = spark.createDataFrame([(j, f"c{j}") for j in range(4)], "j int, name string")
    got = post.reports(found, [1, 2], w_names, h_names, options=post.PostOptions(cutoff=0.4), repeats=1)
    return got[1].clusters.select("side", "name", "signal")
