"""Results on disk: a content key of the input, cached solutions, tables in the shared folder, CSV and GeoJSON sinks."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F


_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one on a local master; elsewhere executors wouldn't
    see each other's files there, so RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='sigmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder for a table that drop_tables deletes."""
    path = f"{shared_folder(spark)}/sigmill/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialized(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written(spark: SparkSession) -> int:
    """How many tables in the shared folder this application has now; a mark for drop_tables."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def drop_tables(spark: SparkSession, since: int = 0, before: int | None = None) -> None:
    """Delete the tables that new_table() and materialized() have made from one mark to another. Frames made from them can't
    be read any more, so call it when what is made of them has been written."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths[since:before]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del paths[since:before]


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which is checked; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def content_key(df: DataFrame) -> str:
    """64 hex digits that depend on the rows and not on their order; equal rows count."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    got = df.select(row.alias("h")).agg(*[F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)], F.count(F.lit(1)).alias("n"))
    text = F.concat_ws("/", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(8)], F.col("n").cast("string"))
    return got.select(F.sha2(text, 256)).first()[0]


def check_key(df: DataFrame, path: str) -> str:
    """The content key, kept beside the results; a different one there gives a warning only."""
    spark, key = df.sparkSession, content_key(df)
    try:
        old = spark.read.text(path).first()
        if old and old[0] != key:
            warnings.warn(f"the data have changed since {path} was written", stacklevel=2)
            return key
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return key


def save_solutions(found: DataFrame, root: str, case: str) -> None:
    """Parquet by case and k; an existing case is kept, with a warning."""
    spark = found.sparkSession
    if load_solutions(spark, root, case).limit(1).count():
        warnings.warn(f"{case} is there already and stays as it is", stacklevel=2)
        return
    found.withColumn("case", F.lit(case)).write.partitionBy("case", "k").mode("append").parquet(root)


def load_solutions(spark: SparkSession, root: str, case: str, ks: list[int] | None = None) -> DataFrame:
    """Cached solutions; an empty frame if there are none."""
    from ..operators.factorize import SOLUTION

    try:
        got = spark.read.schema(SOLUTION + ", case string").parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SOLUTION)
    got = got.where(F.col("case") == case)
    return (got.where(F.col("k").isin(ks)) if ks else got).drop("case")


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=separator)


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=separator)


def joined_path(spark: SparkSession, path: str, *parts: str) -> str:
    """path/part/.. after its parent folders were made, in whatever store it's in."""
    whole = "/".join([path.rstrip("/"), *(p.strip("/") for p in parts)])
    parent = spark._jvm.org.apache.hadoop.fs.Path(whole).getParent()
    if parent is not None:
        parent.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(parent)
    return whole


def load_choice(spark: SparkSession, root: str, case: str, ks: list[int], cutoff: float = 0.5, strict: bool = True) -> tuple[DataFrame, int | None]:
    """(cached solutions of the ks, chosen k); without any, an empty frame and None."""
    from ..operators.factorize import chosen_k

    found = load_solutions(spark, root, case, ks)
    return found, chosen_k(found, cutoff, strict)
