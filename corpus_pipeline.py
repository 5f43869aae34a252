"""A corpus pipeline over documents: toxicity, near-dedup, suffix dedup, source mixing, packing.

Each stage works on all that the one before it kept; the result of each is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigmill.llm.common import shared_dir, table
from sigmill.llm.minhash_dedup import representatives
from sigmill.llm.poisson_mix import poisson_mix
from sigmill.llm.pow2_packing import pow2_packing
from sigmill.llm.suffix_dedup import without_repeats
from sigmill.llm.toxicity_knn import fit, learnable, score
from sigmill.sources.store import drop_tables, tables_written

#: Bytes of a string that is removed where it repeats: under those of nearly any passage of 50 words, over those of common phrases.
LENGTH, GRAM = 240, 80

def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, by a model of the labels' learning folds."""
    model = fit(docs.select("doc_id", "text"), learnable(table(spark, sf_dir, "labels")))
    return score(docs, model).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return representatives(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of LENGTH bytes that start more than once."""
    return without_repeats(docs, length=LENGTH, gram=GRAM)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size, as many rows as before in the mean."""
    return poisson_mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 1024 tokens."""
    return pow2_packing(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix", mix), ("pack", pack)]

#: SQL can't express the neighbours, sketches and tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = tables_written(spark)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_tables(spark, mark)  # the stage's own tables; its result is written
    return docs
