"""Long tables to matrices: pivots by date and id, and pivots with each id's own time origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import missing as m


def date_matrix(df: DataFrame, id_col: str, date_col: str, value: str, dates: DataFrame | None = None, ids: list | None = None, mode: str = "sum", wide: bool = False) -> DataFrame:
    """(date, id, value) with duplicates summed (or averaged); dates and ids filter; ids that sum to 0 are left out.

    wide: one column an id, for lists of ids that fit a schema; otherwise the matrix stays long.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(date_col).alias("date"), m.value(value).alias("v")).where("v is not null")
    if dates is not None:
        rows = rows.join(dates.select(F.col(dates.columns[0]).alias("date")).distinct(), "date", "left_semi")
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    cells = rows.groupBy("date", "id").agg((F.sum if mode == "sum" else F.avg)("v").alias("v"))
    live = cells.groupBy("id").agg(F.sum("v").alias("_t")).where("_t <> 0").select("id")
    cells = cells.join(live, "id", "left_semi")
    if not wide:
        return cells.select("date", "id", "v")
    return cells.groupBy("date").pivot("id", ids).agg(F.first("v"))


def shifted_matrix(df: DataFrame, id_col: str, month_col: str, value: str, record: int | None = None) -> DataFrame:
    """(id, place, v, start, end): months counted from the id's first positive month to its last, duplicates summed; with a
    record length no more than so many places."""
    rows = df.select(F.col(id_col).alias("id"), F.trunc(F.col(month_col).cast("date"), "month").alias("month"), m.value(value).alias("v")).where("v is not null")
    cells = rows.groupBy("id", "month").agg(F.sum("v").alias("v"))
    ends = cells.where("v > 0").groupBy("id").agg(F.min("month").alias("start"), F.max("month").alias("end"))
    inside = cells.join(ends, "id").where("month >= start and month <= end")
    out = inside.select("id", (F.months_between("month", "start") + 1).cast("int").alias("place"), "v", "start", "end")
    return out if record is None else out.where(F.col("place") <= record)
