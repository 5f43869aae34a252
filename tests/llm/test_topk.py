import math

import numpy as np
import pytest

from sigmill.llm.histogram_topk import histogram_topk, op10_histogram_topk, quantized

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k=5):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in [x for x in fine if queries(x[0])]:
        s = sorted([(-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(b) == len(a)])[:k]
        out += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    return sorted(out)


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # one vector fills a third
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, [1.0] * 8), (2050, [1.0] * 3), (2100, [2.0] * 3)]
    v = quantized(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want = brute(rows, lambda i: i % 50 == 0)
    for block, bins in ((2048, 64), (4, 4)):
        got = histogram_topk(v.where("vec_id % 50 = 0"), v, block=block, bins=bins).collect()
        assert sorted(map(tuple, got)) == want


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6 * (i % 3), 3.0]) for i in range(60)]
    v = quantized(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, histogram_topk(v.where("vec_id % 50 = 0"), v).collect())) == brute(rows, lambda i: i % 50 == 0)


def test_few_candidates_and_none(spark):
    v = quantized(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.0])], SCHEMA))
    assert len(histogram_topk(v.where("vec_id % 50 = 0"), v).collect()) == 4
    none = quantized(spark.createDataFrame([], SCHEMA))
    assert histogram_topk(none, none).count() == 0


def test_every_finite_vector_takes_part(spark):
    """Components of 1e6 in 64 dimensions, and some whose products leave 64 bits where nobody wants them."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(120)]
    rows += [(150, [1e6] * 64), (151, [1e6] * 64), (152, [-3e30] * 64), (153, [float(2**60)] + [-1.0] * 63)]
    v = quantized(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(map(tuple, histogram_topk(v.where("vec_id = 0 or vec_id = 150"), v.where("vec_id < 152")).collect()))
    assert got == brute(rows[:-2], lambda i: i in (0, 150)) and (150, 1, 151, 256_000_000**2 * 64) in got
    last = [float(2**60)] + [-1.0] * 63
    small = [(0, [0.0] * 64), (1, last), (2, [0.125] * 64), (3, [-3e30] * 64)]
    v = quantized(spark.createDataFrame(small, SCHEMA))
    assert sorted(map(tuple, histogram_topk(v.where("vec_id = 0"), v).collect())) == brute(small, lambda i: i == 0)
    with pytest.raises(Exception, match="verflow|too (large|big)|out of bounds|int"):
        histogram_topk(v.where("vec_id = 3"), v).collect()


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows = [(0, [1.0, 2.0], 5, "x")] * 40 + [(0, [2.0, 1.0], 5, "x")] + [(i, [i / 9, 1.0], i, "y") for i in range(1, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, q long, block string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op10_histogram_topk(spark, str(tmp_path)).collect()
    assert len(got) == 15 and sorted(r["rank"] for r in got if r.query_id == 0) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert all(r.vec_id != r.query_id for r in got)


def test_refined_ranges_count_no_score_twice(spark):
    """Near copies of few vectors: the range of the kth value is divided again, in parts that don't fit it evenly."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 64))
    near = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 64)) * 0.002
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    v = quantized(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want = brute(rows, lambda i: i % 50 == 0)
    for bins in (64, 10):
        assert sorted(map(tuple, histogram_topk(v.where("vec_id % 50 = 0"), v, bins=bins).collect())) == want


def test_empty_vectors_meet_each_other(spark):
    rows = [(i, []) for i in range(0, 30, 2)] + [(50, [1.0]), (51, [2.0]), (53, None)]
    v = quantized(spark.createDataFrame(rows, SCHEMA))
    got = sorted(map(tuple, histogram_topk(v.where("vec_id % 50 = 0"), v).collect()))
    assert got == [(0, r, 2 * r, 0) for r in range(1, 6)] + [(50, 1, 51, 256 * 512)]
