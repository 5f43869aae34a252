"""One-hot codes, decoding and level types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import missing as m
from ..sources.store import bounded
from .order import numbered


def levels_in_order(df: DataFrame, col: str, order: str) -> DataFrame:
    """(value, level): distinct values numbered from 1 by first appearance."""
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(order).alias("_f"))
    return numbered(first, [F.asc("_f"), F.asc("value")], "level").select("value", "level")


def one_hot(df: DataFrame, col: str, order: str) -> DataFrame:
    """(order, level, code): a 1 at the value's level, 0 at the others, missing for a missing value. Levels are few."""
    levels = levels_in_order(df, col, order)
    return df.select(order, col).crossJoin(bounded(levels)).select(order, "level", F.when(F.col(col).isNotNull(), (F.col(col) == F.col("value")).cast("int")).alias("code"))


def decode(codes: DataFrame, key: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Sum of each row's codes times the levels' weights (1 by default)."""
    w = F.lit(1.0)
    if weights:
        w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("level")]
    return codes.groupBy(key).agg(F.sum(F.col("code") * w).alias("value"))


def level_types(df: DataFrame, cols: list[str], key: str, levels: tuple[float, ...] = (0.05, 0.35)) -> DataFrame:
    """Each row's combination of column levels, numbered from 1 by first appearance: (key, code, type)."""
    def level(c):
        out = F.lit(1)
        for i, cut in enumerate(levels):
            out = F.when(m.value(c) > cut, i + 2).otherwise(out)
        return out

    coded = df.select(key, F.concat_ws("", *[level(c).cast("string") for c in cols]).alias("code"))
    types = levels_in_order(coded, "code", key).withColumnsRenamed({"value": "code", "level": "type"})
    return coded.join(types, "code").select(key, "code", "type")


def type_colors(df: DataFrame, col: str, colors: list[str], other: str = "gray", to: str = "color") -> DataFrame:
    """A color for each row by its type, types in sorted order; with more types than colors all are other."""
    found = sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(len(colors) + 1).collect())
    if len(found) > len(colors):
        return df.withColumn(to, F.lit(other))
    color = F.lit(None).cast("string")
    for value, name in zip(found, colors):
        color = F.when(F.col(col) == F.lit(value), name).otherwise(color)
    return df.withColumn(to, color)


def decode_blocks(codes: DataFrame, key: str, attribute: str, weight: str) -> DataFrame:
    """(key, attribute, value): the sum of code times weight over each attribute's block of columns."""
    return codes.groupBy(key, attribute).agg(F.sum(F.col("code") * m.value(weight)).alias("value"))
