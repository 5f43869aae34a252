"""Helpers shared by the corpus operators.

Conventions used by every operator here:

* A null text counts as an empty text.
* A null ``doc_id`` is kept; such rows are told apart by their text only.
* Columns that an operator doesn't need are ignored, so clashing names in the input are harmless:
  each operator first selects what it needs under its own names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import materialized, shared_folder

#: Stands for a null doc_id in join keys.
NO_ID = -(2**63)


def fold(doc_id: Column | str) -> Column:
    """The doc's fold 0..4: crc32 of doc_id as text, mod 5. A null doc_id gives null: it's neither learned from nor held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def held_out(doc_id: Column | str) -> Column:
    """Whether the doc's fold is 0; false for a null doc_id."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_dir, materialize = shared_folder, materialized


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Let Arrow batches have at most so many rows where the session still has the default: texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(most))


def keyed(docs: DataFrame) -> DataFrame:
    """(k, th, text): k is doc_id or NO_ID, th a hash of the text; rows that agree in both are equal rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array, without copies for each row; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(off: np.ndarray, most: int):
    """Row ranges (i, j) of about most bytes each; a longer row comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
