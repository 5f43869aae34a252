import math

import pytest
from pyspark.sql import functions as F

from sigmill.functions import missing as m, scalar as s

NAN = float("nan")


@pytest.fixture(scope="module")
def vals(spark):
    return spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 6.0), (3, NAN, 9.0), (4, 4.0, 12.0), (5, None, None)], "i int, x double, y double")


def test_reductions_skip_missing(vals):
    r = vals.agg(m.sum_("x"), m.mean("x"), m.largest("x"), m.smallest("x"), m.count("x"), m.variance("x"), m.norm("x")).first()
    assert list(r)[:5] == [7.0, 7 / 3, 4.0, 1.0, 3] and abs(r[5] - 7 / 3) < 1e-12 and abs(r[6] - math.sqrt(21)) < 1e-12


def test_all_missing_is_missing(spark):
    d = spark.createDataFrame([(NAN,), (None,)], "x double")
    assert list(d.agg(m.sum_("x"), m.mean("x"), m.largest("x"), m.variance("x"), m.correlation("x", "x")).first()) == [None] * 5


def test_pairs(vals, spark):
    assert abs(vals.agg(m.r2("x", "y")).first()[0] - 1) < 1e-12
    d = spark.createDataFrame([(1.0, 2.0), (NAN, 10.0), (3.0, NAN)], "x double, y double")
    assert list(d.agg(m.rmse("x", "y"), m.l1("x", "y"), m.distance("x", "y"), m.covariance("x", "y")).first()) == [1.0, 1.0, 1.0, None]
    e = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert abs(e.agg(m.explained("x", "y")).first()[0] - (1 - 1 / 0.5)) < 1e-12


def test_parsing(spark):
    d = spark.createDataFrame([("1",), ("",), ("NaN",), ("-2",), ("bad",), (None,)], "v string")
    assert [r[0] for r in d.select(m.parsed("v")).collect()] == [1.0, None, None, -2.0, None, None]


def test_isotopes_round_trip(spark):
    d = spark.createDataFrame([(20.0, 100.0), (10.0, 10.0), (1.0, 1.0)], "delta double, c double").withColumn("iso", s.isotope_concentration("delta", 0.001, "c"))
    for r in d.withColumn("back", s.isotope_delta("iso", 0.001, "c")).collect():
        assert abs(r.back - r.delta) < 1e-8


def test_geodesy(spark):
    d = spark.createDataFrame([(36.12, -86.67, 33.94, -118.40)], "a double, b double, c double, d double")
    assert abs(d.select(s.haversine("a", "b", "c", "d")).first()[0] - 2887.26) < 0.1
    x, y = s.utm("a", "b", F.lit(16))
    got = d.select(x.alias("x"), y.alias("y")).first()
    assert abs(got.x - 529_700) < 300 and abs(got.y - 3_997_300) < 600
    lat, lon = s.utm_back("x", "y", F.lit(16))
    r = d.select(x.alias("x"), y.alias("y")).select(lat, lon).first()
    assert abs(r[0] - 36.12) < 1e-8 and abs(r[1] + 86.67) < 1e-8


def test_text_and_levels(spark):
    d = spark.createDataFrame([("a(b)&<c–", 27)], "s string, n int")
    r = d.select(s.safe_name("s"), s.cluster_letter("n", 30), s.cluster_letter("n", 40), s.upper_at(F.lit("abc"), 3), s.contour_level(F.lit(2.5), 0, 4, 4), s.contour_level(F.lit(9.0), 0, 4, 4), s.spaced_points(3, 5.0)).first()
    assert list(r)[:6] == ["a[b)andltc-", "[", "T27", "abC", 2.0, 4.0] and list(r[6]) == [2.0, 3.0, 4.0]


def test_periodic_distance(spark):
    assert spark.range(1).select(s.periodic_distance([F.lit(23.0)], [F.lit(1.0)], [24.0], [1.0])).first()[0] == 2.0


def test_hashed_uniform_is_stable(spark):
    a = spark.range(1000).select("id", s.hashed_uniform(3, "id").alias("u"))
    assert sorted(a.collect()) == sorted(spark.range(1000).repartition(5).select("id", s.hashed_uniform(3, "id").alias("u")).collect())
    assert abs(a.agg(F.avg("u")).first()[0] - 0.5) < 0.03
