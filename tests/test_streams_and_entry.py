import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sigmill.streaming import stream as st

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    batch = st.tumbling_matrix(events, "ts", "event_type", "value")
    live = st.tumbling_matrix(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value", late="1 hour")
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.name, round(r.total, 6), r.n) for r in df.collect())
    assert key(spark.table("live")) == key(batch)


def test_streamed_fold_in(spark, tmp_path):
    h = np.array([[1.0, 0, 2], [0, 3, 1]])
    rows = spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i + 1]) for i in range(10)], "id int, x array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    q = st.write_fold_in(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), h, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r.id: r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 10 and np.allclose(got[4], [4, 1], atol=1e-4)


def test_streamed_peaks(spark, tmp_path):
    y = [1, 1.1, 1, 0.9, 1, 1.1, 1, 0.9, 9, 1, 1.1, 1]
    spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "s string, i int, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = st.streaming_peaks(spark.readStream.schema("s string, i int, v double").parquet(str(tmp_path / "in")), "s", "i", "v", 5, 4.0)
    q = live.writeStream.format("memory").queryName("peaks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.signal for r in spark.table("peaks").orderBy("i").collect()] == [0] * 8 + [1, 0, 0, 0]


def test_entry_and_names(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 3 and out.columns == ["k", "fit", "robustness", "aic", "chosen"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_corpus_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "sigmill", tmp_path / "sigmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0


@pytest.mark.parametrize("name", ["nan_reductions", "df2matrix_shifted", "cosine_silhouette", "grid_mean", "indicize_bins", "mu_step_1", "log_norm", "signal_members", "nearest_spacing"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{DATA}/{x}.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_mixture_query_uses_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 6))
    v[:100, 5] += 30  # apart in the last component only
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster for r in __spark_entry__.queries()["gmm_select"](spark, str(tmp_path)).collect()}
    assert len(got) == 300 and not {got[i] for i in range(100)} & {got[i] for i in range(100, 300)}
