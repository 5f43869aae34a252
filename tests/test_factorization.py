import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import cluster, factorize as fz, kernels as K, post
from sigmill.sources import store


def frame(spark, x):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")


def sources(k, seed=1, n=15):
    s = np.random.default_rng(seed).random((n, k))
    if k == 2:
        a, b = s.T
        return np.column_stack([a, 10 * a, b, 5 * b, a + 2 * b])
    a, b, c = s.T
    return np.column_stack([a + 3 * c, 10 * a, b, 5 * b + c, a + 2 * b + 5 * c])


def test_two_sources_are_recovered(spark):
    found = fz.sweep(frame(spark, sources(2, n=20)), [2], fz.Options(runs=10)).first()
    assert found.fit < 0.1 and found.robustness > 0.9
    for h in found.h:
        lead = h[1] > h[3]
        assert abs((h[1] / h[0] if lead else h[3] / h[2]) / (10 if lead else 5) - 1) < 0.1
        assert abs(sum(h) - 1) < 1e-9


def test_k_is_chosen(spark):
    found = fz.sweep(frame(spark, sources(3)), [2, 3, 4], fz.Options(runs=10)).cache()
    assert fz.chosen_k(found) == 3 and fz.chosen_ks(found, 0.5) == [2, 3]
    assert [r.k for r in fz.with_choice(found).where("chosen").collect()] == [3]
    w, h = fz.factor_cells(found, 3)
    assert w.count() == 45 and h.count() == 15


def test_missing_cells_and_errors(spark):
    x = sources(2, n=20)
    x[3, 2] = np.nan
    r = fz.sweep(frame(spark, x), [2], fz.Options(runs=6)).first()
    assert r.fit < 0.1
    with pytest.raises(ValueError):
        K.multiplicative(-x, 2)
    with pytest.raises(TypeError):
        fz.Options(nonsense=1)
    with pytest.raises(ValueError):
        fz.to_matrix(frame(spark, x), most_cells=10)


def test_kernels():
    x = sources(2, n=20)
    for w, h, fit in (K.sparse(x, 2, 1, sparsity=0.0, max_iter=3000), K.alternating(x, 2, 1), K.sparse(x, 2, 1, "kl", 0.0, 3000)):
        assert (w >= 0).all() and (h >= 0).all() and fit < 0.15 * np.linalg.norm(x)
    w = np.random.default_rng(0).dirichlet([1, 1], 20)
    h = np.array([[100.0, 0, 3], [5, 10, 20]])
    gap = w @ h
    gap[0, 0] = np.nan
    w2, h2, _, fit = K.mixing(gap, 2, 0)
    assert np.allclose(w2.sum(axis=1), 1) and fit < 0.05 * np.linalg.norm(w @ h)
    assert np.allclose(K.to_simplex(np.array([[0.2, 0.8], [5.0, 0.0]])), [[0.2, 0.8], [1, 0]])
    a = np.abs(np.random.default_rng(0).normal(size=(9, 3)))
    assert np.allclose(K.nonnegative_solve(a, a @ h.T @ np.ones((2, 2))), h.T @ np.ones((2, 2)), atol=1e-3)
    assert K.bootstrap(np.ones((5, 2)) * 10, 1).sum(axis=0).round().tolist() == [50, 50]


def test_matching_and_silhouettes():
    f = np.random.default_rng(0).random((3, 12))
    labels = K.matched([f, f[[2, 0, 1]], f * 2])
    assert labels.tolist() == [[0, 1, 2], [2, 0, 1], [0, 1, 2]]
    s = K.silhouettes([f, f[[2, 0, 1]], f * 2], labels)
    assert np.allclose(s, 1)
    assert cluster.greedy_assignment(np.array([[0, 0, 9, 0], [8, 0, 0, 0], [0, 0, 0, 7], [0, 6, 0, 0.0]]))[0] == [2, 0, 3, 1]
    assert cluster.greedy_assignment(np.array([[10, 9], [8, 0.0]])) is None and cluster.best_assignment(np.array([[10, 9], [8, 0.0]]))[0] == [1, 0]


def test_tall_equals_kernel_quality(spark):
    x = sources(2, n=200)
    w, h, fit = fz.factorize_tall(frame(spark, x), 2, iterations=60)
    got = np.array([r.w for r in w.orderBy("id").collect()])
    assert np.linalg.norm(x - got @ h) < 0.1 * np.linalg.norm(x) and fit < 0.1 * np.linalg.norm(x)


def test_fold_in_mapping_progressive(spark):
    x = sources(2, n=30)
    h = np.array([[1, 10, 0, 0, 1], [0, 0, 1, 5, 2.0]])
    w = np.array([r.w for r in fz.fold_in(frame(spark, x), h).orderBy("id").collect()])
    assert np.linalg.norm(x - w @ h) < 1e-3
    hh, y = fz.mapping(x[:, :3], x[:, 3:], frame(spark, x[:, :3]))
    assert np.allclose([r.y for r in y.orderBy("id").collect()], x[:, 3:], atol=1e-2)
    p = fz.progressive(frame(spark, x), [15, 30], [2], fz.Options(runs=3)).collect()
    assert [r.window for r in p] == [15, 30] and all(r.k == 2 and r.fit_all < 1 for r in p)


def test_uncertainty_and_tensor(spark):
    x = (sources(2) * 50).round()
    u = fz.uncertainty(frame(spark, x), 2, 4, fz.Options(max_iter=200))
    assert u.count() == x.size and u.where("least > largest").count() == 0
    cells = spark.createDataFrame([(i, j, k, float(x[i, j] * (k + 1))) for i in range(15) for j in range(5) for k in range(2)], "a int, b int, c int, v double")
    assert fz.tensor_sweep(cells, ["a", "b", "c"], [2], fz.Options(runs=3, max_iter=100), ["b"]).count() == 1


def test_cache(spark, tmp_path):
    x = frame(spark, sources(2))
    assert store.load_solutions(spark, str(tmp_path / "none"), "c").count() == 0
    found = fz.sweep(x, [2], fz.Options(runs=2, max_iter=50))
    store.save_solutions(found, str(tmp_path / "r"), "c")
    assert store.load_solutions(spark, str(tmp_path / "r"), "c", [2]).first().fit == pytest.approx(found.first().fit)
    with pytest.warns(UserWarning):
        store.save_solutions(found, str(tmp_path / "r"), "c")
    key = store.content_key(x)
    assert len(key) == 64 and key == store.content_key(x.repartition(3)) != store.content_key(frame(spark, sources(2) + 1))
    assert store.check_key(x, str(tmp_path / "k")) == store.check_key(x, str(tmp_path / "k"))


def test_clusters(spark):
    r = np.random.default_rng(0)
    v = [(i, int(i % 3), (np.eye(3)[i % 3] * 5 + r.random(3) * 0.5).tolist()) for i in range(60)]
    d = spark.createDataFrame(v, "id int, g int, vec array<double>")
    s = {x.id: x.silhouette for x in cluster.cosine_silhouettes(d, "vec", "g", "id").collect()}
    u = np.array([x[2] for x in v]) / np.linalg.norm([x[2] for x in v], axis=1)[:, None]
    dist = 1 - u @ u.T
    g = np.array([x[1] for x in v])
    for i in (0, 7):
        a = dist[i][(g == g[i]) & (np.arange(60) != i)].mean()
        b = min(dist[i][g == q].mean() for q in range(3) if q != g[i])
        assert abs(s[i] - (b - a) / max(a, b)) < 1e-9
    rows, mean, worst = cluster.kmeans(d, "vec", "id", 3, 2)
    assert worst > 0.8 and rows.groupBy("g").agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0
    assert cluster.after_cliff([2, 3, 4], [0.9, 0.8, 0.1]) == 4
    c = cluster.compress_rows(d, "vec", "id", [2, 3], 1)
    assert c.groups.count() == 3 and cluster.decompress_rows(c, "id").count() == 60


def test_report(spark):
    found = fz.sweep(frame(spark, sources(2, n=20)), [2], fz.Options(runs=4)).cache()
    w_names = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "i int, name string")
    h_names = spark.createDataFrame([(j, f"c{j}") for j in range(5)], "j int, name string")
    rep = post.report(found, 2, w_names, h_names)
    assert rep.clusters.where("side = 'W'").count() == 20 and rep.ranking.where("share > 1.0000001").count() == 0
    total = rep.shares.groupBy("i", "j").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-6 and s <> 0").count()
    assert total == 0 and post.association(rep.shares).count() > 0


def test_mixing_with_ratios_and_deltas():
    w = np.random.default_rng(0).dirichlet([1, 1], 24)
    h = np.array([[100.0, 2, 30], [5, 10, 20]])
    x = w @ h
    ratios = (x[:, 0] / x[:, 1])[:, None].copy()
    x[:8, 1] = np.nan  # only the ratio tells about these
    w2, h2, _, _ = K.mixing(x, 2, 1, 6000, ratios=ratios, ratio_pairs=[(0, 1)])
    got = w2 @ h2
    assert np.nanmax(np.abs(got[:8, 0] / got[:8, 1] / ratios[:8, 0] - 1)) < 0.3
    d = np.array([[-3.0], [4.0]])
    a = w * h[:, 0]
    delta = (a / a.sum(axis=1, keepdims=True)) @ d
    _, _, d2, _ = K.mixing(w @ h, 2, 0, 6000, deltas=delta, delta_columns=[0])
    assert d2.shape == (2, 1) and abs(np.ptp(d2)) > 1


def test_selection_and_cached_sweep(spark, tmp_path):
    x = frame(spark, sources(2))
    o = fz.Options(runs=3, max_iter=200)
    a = fz.sweep_cached(x, [2], str(tmp_path), o=o).first()
    b = {r.k: r.fit for r in fz.sweep_cached(x, [2, 3], str(tmp_path), o=o).collect()}
    assert b[2] == a.fit and set(b) == {2, 3}
    cells = x.select(F.col("id").alias("i"), F.posexplode("x").alias("j", "v"))
    got = {r.k: r for r in fz.selection_table(fz.sweep(x, [2, 3], o), cells).collect()}
    assert got[2].r2 > 0.99 and max(r.fit for r in got.values()) == 1.0
