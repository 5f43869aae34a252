import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import binning, encode, order, pivot, profile, reduce as rd, spatial, transform as tr, windows as wn

NAN = float("nan")


def col(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def out(df, c="v", key="i"):
    return [r[c] for r in df.orderBy(key).collect()]


def test_minmax(spark):
    assert out(tr.minmax(col(spark, [1.0, NAN, 3.0]), ["v"])) == [0.0, None, 1.0]
    assert out(tr.minmax(col(spark, [1.0, 2.0, 3.0]), ["v"], reverse=True)) == [1.0, 0.5, 0.0]
    assert out(tr.minmax(col(spark, [2.0, 2.0]), ["v"], constant="one")) == [1.0, 1.0] and out(tr.minmax(col(spark, [2.0, 2.0]), ["v"])) == [0.0, 0.0]
    assert out(tr.denormalize(tr.minmax(col(spark, [1.0, 2.0, 3.0]), ["v"]), {"v": (1.0, 3.0)})) == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("values", [[1.0, 10.0, 100.0], [-1.0, 5.0, 20.0], [-3.0, -20.0], [0.0, 5.0, 50.0], [0.0, -5.0]])
def test_log_scaling_round_trip(spark, values):
    d = tr.log_scaled(col(spark, values), "v")
    assert 0 <= min(out(d)) and max(out(d)) <= 1
    assert np.allclose(out(tr.log_unscaled(d, "v")), values)


def test_masks_and_fills(spark):
    assert out(tr.mask_at_most(col(spark, [0.0, 1.0, 2.0, 3.0]), ["v"], 1)) == [None, None, 2.0, 3.0]
    assert out(tr.impute_mean(col(spark, [1.0, NAN, 3.0]), ["v"])) == [1.0, 2.0, 3.0] and out(tr.impute_mean(col(spark, [NAN]), ["v"])) == [0.0]
    assert out(tr.reflect(col(spark, [1.0, 2.0, 3.0]), ["v"])) == [3.0, 2.0, 1.0]
    all_rows = col(spark, [1.0, 2.0, 3.0])
    assert out(tr.reinsert_rows(all_rows.where("v > 1"), all_rows, ["i"])) == [None, 2.0, 3.0]
    assert out(tr.coerce(col(spark, ["1", "", "NaN", "-2", "bad", None], "string"), ["v"], negatives=False)) == [1.0, None, None, 0.0, None, None]
    g = tr.gather(col(spark, [10.0, 20.0]), spark.createDataFrame([(0, 0), (1, None), (2, 1)], "t int, s int"), "i", "t", "s", ["v"])
    assert out(g, key="t") == [10.0, None, 20.0]
    assert tr.rename(spark.createDataFrame([(1, 2)], "a_x int, b_x int"), {"_x": "p", "b_x": "q"}, "end").columns == ["p", "q"]


def test_unfold(spark):
    cells = spark.createDataFrame([(i, j, k, i * 12 + j * 4 + k) for i in range(2) for j in range(3) for k in range(4)], "a int, b int, c int, v int")
    for keep, shape in (("a", (12, 2)), ("b", (8, 3)), ("c", (6, 4))):
        u = tr.unfold(cells, ["a", "b", "c"], keep)
        assert u.count() == 24 and (u.select("row").distinct().count(), u.select("col").distinct().count()) == shape


def test_windows(spark):
    assert out(wn.cumulative_sum(col(spark, [1.0, NAN, 2.0]), "v", "i"), "cum") == [1.0, 1.0, 3.0]
    assert out(wn.neighbourhood(col(spark, [1.0, 2.0, 3.0]), "v", "i"), "near") == [1.5, 2.0, 2.5]
    assert out(wn.slopes(col(spark, [1.0, 2.0, 4.0]), "v", "i"), "slope") == [1.0, 1.5, 2.0]
    assert out(wn.moving_mean(col(spark, [1.0, 2.0, 3.0, 4.0]), "v", "i", 2), "mean") == [1.0, 1.5, 2.5, 3.5]
    assert list(wn.step_range(col(spark, [1.0, 3.0, 2.0]), "v", "i").first()) == [-1.0, 2.0, 3.0]
    assert wn.pattern_places(col(spark, [1.0, 2.0, 3.0, 2.0, 3.0]), "v", "i", [2.0, 3.0]).first().place == 1


def test_peaks(spark):
    y = [1, 1.1, 1, 0.9, 1, 1.1, 1, 0.9, 9, 1, 1.1, 1]
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("b", i, 0.0) for i in range(12)], "s string, i int, v double")
    assert [r.signal for r in wn.peaks(d, "v", "i", ["s"], lag=5, threshold=4).where("s = 'a'").orderBy("i").collect()] == [0] * 8 + [1, 0, 0, 0]
    assert [tuple(r) for r in wn.first_jump(d, "v", "i", ["s"], lag=5, threshold=4).collect()] == [("a", 7)]  # the place before the rise has a positive value


def test_bins(spark):
    five = col(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert out(binning.bin_index(five, "v", step=1.0), "bin") == [1, 1, 2, 3, 4]
    assert out(binning.bin_index(five, "v", step=1.0, reverse=True), "bin") == [4, 4, 3, 2, 1]
    assert [r.centre for r in binning.bin_centres(col(spark, [0.0, 2.0]), "v", 2).orderBy("bin").collect()] == [0.5, 1.5]
    g = binning.grid_mean(spark.createDataFrame([(0.0, 0.0, 10.0), (0.1, 0.1, 20.0), (1.0, 1.0, NAN)], "x double, y double, z double"), "x", "y", "z", 2, 2)
    assert {(r.ix, r.iy): (r["mean"], r.n) for r in g.collect()} == {(1, 1): (15.0, 2), (2, 2): (None, 0), (1, 2): (None, 0), (2, 1): (None, 0)}


def test_order_and_codes(spark):
    d = col(spark, [2.0, NAN, 1.0])
    assert out(order.sort_places(d, "v", "i"), "place") == [3, 1, 2] and out(order.sort_places(d, "v", "i", descending=True), "place") == [1, 3, 2]
    assert [r.v for r in order.sorted_values(d, "v", keep_missing=False).collect()] == [1.0, 2.0]
    codes = encode.one_hot(col(spark, [1, 2, 1], "int"), "v", "i")
    assert [r.code for r in codes.orderBy("i", "level").collect()] == [1, 0, 0, 1, 1, 0]
    assert [r.value for r in encode.decode(codes, "i").orderBy("i").collect()] == [1.0, 1.0, 1.0]
    assert sorted(map(tuple, rd.value_counts(col(spark, [1, 1, 2, 3, 3, 3], "int"), "v").collect())) == [(1, 2), (2, 1), (3, 3)]


def test_pivots(spark):
    d = spark.createDataFrame([("a", "2020-01-05", 0.0), ("a", "2020-02-01", 2.0), ("a", "2020-02-20", 3.0), ("a", "2020-04-01", 1.0), ("a", "2020-05-01", 0.0), ("b", "2020-01-01", 0.0)], "w string, d string, v double")
    got = pivot.shifted_matrix(d.withColumn("d", F.to_date("d")), "w", "d", "v").orderBy("place").collect()
    assert [(r.id, r.place, r.v) for r in got] == [("a", 1, 5.0), ("a", 3, 1.0)]
    assert {r.id for r in pivot.date_matrix(d, "w", "d", "v").collect()} == {"a"}


def test_profiles(spark):
    d = spark.createDataFrame([(float(i), float(2 * i), 1.0, "t", None, i % 2) for i in range(20)], "a double, b double, c double, s string, e double, f int")
    p = {r.name: r for r in profile.profile(d).collect()}
    assert p["e"].missing and p["c"].constant and p["f"].boolean and p["s"].kind == "text" and not p["a"].constant
    assert profile.redundant_columns(d, ["a", "b", "f"]) == [("b", "a", "correlated")]
    cells = spark.createDataFrame([(i, j, None if i == 2 or j == 1 and i == 0 else 1.0) for i in range(3) for j in range(3)], "i int, j int, v double")
    assert [r.i for r in profile.bad_slices(cells, "i").collect()] == [2]
    assert profile.robust_cells(cells, ["i", "j"]).where("i = 2").count() == 0


def test_space(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1.0), (4.0, 0.0, 2.0), (4.0, 4.0, 3.0), (0.0, 4.0, 4.0), (2.0, 2.0, 9.0), (2.0, 2.0, 5.0)], "x double, y double, z double")
    assert [(r.x, r.y) for r in spatial.convex_hull(pts, "x", "y").orderBy("place").collect()] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    one = spatial.largest_at_point(pts, "x", "y", "z")
    v = {(r.i, r.j): r.value for r in spatial.inverse_distance(one, spatial.grid_points(one, "x", "y", 3, 3), "x", "y", "z").collect()}
    assert v[1, 1] == 9.0 and v[0, 0] == 1.0 and 1.0 < v[1, 0] < 9.0
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert pts.where(spatial.in_polygon("x", "y", square)).where("x = 2").count() == 2
    assert not spatial.self_crossing(square) and spatial.self_crossing([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert spatial.cell_edges([1.0, 2.0, 4.0]) == [0.5, 1.5, 3.0, 5.0] and spatial.round_bounds(0.3, 9.7) == (0.0, 10.0)


def test_empty_frames(spark):
    e = spark.createDataFrame([], "i int, v double")
    assert tr.minmax(e, ["v"]).count() == 0 and wn.slopes(e, "v", "i").count() == 0 and rd.value_counts(e, "v").count() == 0


def test_points_names_and_axes(spark):
    from sigmill.functions import scalar as sc

    p = sc.latin_hypercube_points(spark, 20, [21.0, 41.0]).collect()
    assert sorted(int((r.p0 - 1) * 20 / 20) for r in p) == list(range(20)) and sorted(int((r.p1 - 1) * 20 / 40) for r in p) == list(range(20))
    q = sc.random_points(spark, 100, [5.0])
    assert q.where("p0 < 1 or p0 > 5").count() == 0
    assert tr.lonlat_columns(spark.createDataFrame([(1, 2, 3)], "Name int, Latitude int, lon_deg int")) == ("lon_deg", "Latitude")
    assert tr.axis_order((3, 5, 4), (4, 3, 5)) == [2, 0, 1]
    with pytest.raises(ValueError):
        tr.axis_order((3, 5), (4, 3))
    assert len(spatial.densified([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 0.25)) == 4 + 4 + 6
