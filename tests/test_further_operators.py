import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions import scalar as s
from sigmill.operators import cluster, encode, factorize as fz, kernels as K, order, post, profile, spatial, transform as tr, windows as wn
from sigmill.sources import store


def test_logs_without_a_positive_value(spark):
    d = spark.createDataFrame([(1, -100.0), (2, -0.1), (3, None)], "i int, v double")
    assert [r.v for r in tr.log10_safe(d, "v").orderBy("i").collect()] == [2.0, -1.0, None]
    d = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, -5.0), (4, 1000.0)], "i int, v double")
    assert [r.v for r in tr.log10_safe(d, "v").orderBy("i").collect()] == [2.0, 1.0, 1.0, 3.0]


def test_inverses(spark):
    d = spark.createDataFrame([(0, 1.0, 3.0), (1, 5.0, 5.0), (2, None, 2.0)], "i int, a double, b double")
    ends = d.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    back = tr.denormalize_rows(tr.minmax_rows(ends, ["a", "b"]), ["a", "b"], "lo", "hi").orderBy("i").collect()
    assert [(r.a, r.b) for r in back] == [(1.0, 3.0), (5.0, 5.0), (None, 2.0)]
    tops = {"a": 5.0, "b": 5.0}
    assert [(r.a, r.b) for r in tr.descale(tr.over_largest(d, ["a", "b"]), tops).orderBy("i").collect()] == [(1.0, 3.0), (5.0, 5.0), (None, 2.0)]
    cells = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 8.0)], "a int, b int, v double")
    g = tr.slice_ranges(cells, ["a"])
    n = tr.minmax_cells(cells, g, ["a"])
    assert sorted((r.a, r.b, r.v) for r in n.collect()) == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)]
    assert sorted(map(tuple, tr.denormalize_cells(n, g, ["a"]).select("a", "b", "v").collect())) == sorted(map(tuple, cells.collect()))


def test_robust_matrix(spark):
    d = spark.createDataFrame([(0, 1.0, 2.0, 0.0), (1, None, None, None), (2, 3.0, 4.0, 0.0)], "i int, c1 double, c2 double, c3 double")
    rows, gone = profile.robust_matrix(d, ["c1", "c2", "c3"], correlation=None)
    assert [r.i for r in rows.orderBy("i").collect()] == [0, 2] and gone == [("c3", "zeros")]


def test_jump_falls_back_to_the_first_positive_value(spark):
    d = spark.createDataFrame([("a", i, float(i > 3)) for i in range(10)] + [("b", i, 0.0) for i in range(10)] + [("c", 0, 2.0)], "s string, i int, v double")
    assert sorted(map(tuple, wn.first_jump(d, "v", "i", ["s"], lag=30).collect())) == [("a", 4), ("c", 0)]


def test_numbered_over_partitions(spark):
    r = random.Random(1)
    vals = [(i, r.choice([None, 1.0, 2.0, 3.0])) for i in range(500)]
    d = spark.createDataFrame(vals, "i int, v double").repartition(7)
    got = {x.i: x.place for x in order.sort_places(d, "v", "i").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-1.0 if v is None else v, i) for i, v in vals), 1)}
    assert got == want and order.numbered(d.limit(0), ["i"]).count() == 0


def test_concave_hull_and_margins():
    ring = [(math.cos(a), math.sin(a)) for a in np.linspace(0.6, 2 * math.pi - 0.6, 60)]  # open to the right
    inner = [(0.7 * x, 0.7 * y) for x, y in ring]
    got = spatial.concave_hull(ring + inner)
    area = lambda p: 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))
    assert area(spatial.hull(ring)) > area(got) > 0 and set(got) <= set(ring + inner)
    assert spatial.concave_hull(ring[:3]) == spatial.hull(ring[:3])
    assert spatial.expanded([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)], margin=0.5)[0] == (1.5, 0.0)


def test_spacing_of_far_points(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], "k int, x double, y double")
    assert abs(spatial.nearest_spacing(d, "x", "y", "k").first()[0] - math.sqrt(2)) < 1e-12


def test_labels_and_bounds(spark):
    d = spark.createDataFrame([(1.5,), (0.0,), (12.0,)], "v double")
    assert [r.label for r in s.tick_labels(d, "v").orderBy("v").collect()] == ["0", "1.5", "12"]
    d = spark.createDataFrame([(0.00012,), (0.0,), (-2.0,)], "v double")
    assert [r.label for r in s.tick_labels(d, "v").orderBy("v").collect()] == ["-2e0", "0", "1.2e-4"]
    assert spatial.round_bounds(12.3, 97.8) == (0.0, 100.0) and spatial.round_bounds(12.3, 97.8, keep_low=True) == (12.3, 100.0)
    assert spatial.round_bounds(4.0, 4.0) == (4.0, 4.0)
    none = d.where("v > 100")
    assert spatial.color_bounds(none, "v", nice=False) == (0.0, 1.0)


def test_options_and_reports(spark, tmp_path):
    w = [[float(i % 2 == 0) * (1 + i), float(i % 2) * (2 + i)] for i in range(6)]
    h = [[1.0, 0.0, 0.5], [0.0, 1.0, 0.1]]
    found = spark.createDataFrame([(2, 0.0, 1.0, 0.0, w, h, [1.0, 1.0], 1)], fz.SOLUTION)
    w_names = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "i int, name string")
    h_names = spark.createDataFrame([(j, f"c{j}") for j in range(3)], "j int, name string")
    groups = spark.createDataFrame([(f"r{i}", f"g{i % 2}") for i in range(6)], "name string, `group` string")
    got = post.reports(found, [2, 3], w_names, h_names, options={"repeats": 1}, w_groups=groups, result_dir=f"file://{tmp_path}/out")
    assert set(got) == {2} and {r.name for r in got[2].clusters.where("side = 'W'").collect()} == {"g0", "g1"}
    back = store.read_csv(spark, f"file://{tmp_path}/out/attributes-2-groups", "label string, names string")
    assert sorted(r.names for r in back.collect()) == ["g0", "g1"]
    with pytest.raises(ValueError, match="unsupported options: colour"):
        post.reports(found, [2], w_names, h_names, colour=1)
    with pytest.raises(ValueError, match="names by i"):
        post.settings(None, w_names.union(w_names), h_names)


def test_choice_by_factor_and_stored_solutions(spark, tmp_path):
    rows = [(2, 1.0, 0.9, 0.0, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.2], [0.1, 1.0]], [1.0, 1.0], 1), (3, 0.5, 0.1, 0.0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], [[1.0, 0.0], [0.9, 1.0], [0.0, 1.0]], [0.1] * 3, 1)]
    found = spark.createDataFrame(rows, fz.SOLUTION)
    assert fz.ks_by_factor(found, [0], 0.95) == [2, 3] and fz.ks_by_factor(found.where("k = 2"), [0]) == [2]
    root = store.joined_path(spark, f"file://{tmp_path}", "a", "solutions")
    store.save_solutions(found, root, "case")
    got, k = store.load_choice(spark, root, "case", [2, 3])
    assert got.count() == 2 and k == 2 and store.load_choice(spark, root, "none", [2])[1] is None


def test_tables_are_dropped(spark):
    mark = store.tables_written(spark)
    a = store.materialized(spark.range(5))
    assert store.tables_written(spark) == mark + 1 and a.count() == 5
    store.drop_tables(spark, mark)
    assert store.tables_written(spark) == mark
    with pytest.raises(Exception):
        spark.read.schema(a.schema).parquet(a.inputFiles()[0]).count()


def test_compression_with_gaps_and_small_kernels(spark):
    rows = [(i, [float(10 * (i % 2)) + 0.1 * i, None if i == 3 else 1.0, 5.0 * (i % 2)]) for i in range(12)] + [(99, [None, None, None])]
    got = cluster.compress_rows(spark.createDataFrame(rows, "id int, x array<double>"), "x", "id", [2, 3], 1)
    labels = {r.id: r.cluster for r in got.labels.collect()}
    assert labels[99] == 0 and len({labels[i] for i in range(0, 12, 2)}) == 1 and labels[0] != labels[1]
    rng = np.random.default_rng(0)
    x = rng.random((20, 3)) @ rng.random((3, 6))
    assert K.squares(x, 3, 1)[2] < 1e-2
    assert [r.color for r in encode.type_colors(spark.createDataFrame([("b",), ("a",)], "t string"), "t", ["red", "blue"]).collect()] == ["blue", "red"]
