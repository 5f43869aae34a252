"""Column profiles and data-quality checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing as m
from ..sources.store import materialized


def profile(df: DataFrame, cols: list[str] | None = None, low_count: int = 5, skew_cutoff: float = 1.0) -> DataFrame:
    """A row a column: n valid, flags missing, low, zeros, negative, constant, boolean, skewed, text, date and kind. One pass."""
    kinds = dict(df.dtypes)
    cols = cols or df.columns
    aggs = []
    for i, c in enumerate(cols):
        number = kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")
        v = m.value(c) if number else F.col(c)
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v).alias(f"d{i}"), F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}")]
        aggs += [(F.sum(v) if number else F.lit(None).cast("double")).alias(f"s{i}"), (F.count_if(v < 0) if number else F.lit(0)).alias(f"neg{i}"), (F.count_if((v != 0) & (v != 1)) if number else F.lit(-1)).alias(f"odd{i}"), (F.skewness(v) if number else F.lit(None).cast("double")).alias(f"sk{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        n, constant = F.col(f"n{i}"), F.col(f"lo{i}") == F.col(f"hi{i}")
        kind = "date" if kinds[c] in ("date", "timestamp", "timestamp_ntz") else "text" if kinds[c] == "string" else "number"
        rows.append(F.struct(F.lit(c).alias("name"), F.lit(kind).alias("kind"), n.alias("n"), (n == 0).alias("missing"), ((n > 0) & (n <= low_count)).alias("low"), F.coalesce((F.col(f"s{i}") == 0) & (F.col(f"neg{i}") == 0), F.lit(False)).alias("zeros"), (F.col(f"neg{i}") > 0).alias("negative"), F.coalesce(constant, F.lit(False)).alias("constant"), ((F.col(f"odd{i}") == 0) & (n > 0)).alias("boolean"), F.coalesce(F.col(f"sk{i}") > skew_cutoff, F.lit(False)).alias("skewed")))
    return one.select(F.inline(F.array(*rows)))


def redundant_columns(df: DataFrame, cols: list[str], correlation: float = 0.99, priority: list[str] | None = None) -> list[tuple[str, str, str]]:
    """(dropped, kept, why): columns that equal ('same') or follow ('correlated') an earlier one with at least as many values.

    All pairs come from one aggregate; the greedy choice runs over the pairs' figures only.
    """
    order = [*(priority or []), *[c for c in cols if c not in (priority or [])]]
    pairs = list(combinations(order, 2))
    aggs = [m.count(c).alias(f"n_{c}") for c in order]
    for i, (a, b) in enumerate(pairs):
        x, y = m.value(a), m.value(b)
        aggs += [F.count_if(x.eqNullSafe(y)).alias(f"e{i}"), F.count(x + y).alias(f"b{i}"), m.correlation(a, b).alias(f"c{i}")]
    got = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    gone: dict[str, tuple[str, str]] = {}
    for i, (a, b) in enumerate(pairs):
        if a in gone or b in gone or got[f"n_{b}"] > got[f"n_{a}"]:
            continue
        if got[f"e{i}"] == got["rows"]:
            gone[b] = (a, "same")
        elif got[f"b{i}"] > max(2, 0.5 * got[f"n_{b}"]) and got[f"c{i}"] is not None and abs(got[f"c{i}"]) > correlation:
            gone[b] = (a, "correlated")
    return [(b, a, why) for b, (a, why) in gone.items()]


def entry_counts(cells: DataFrame, axis: str, predicate: Column | None = None) -> DataFrame:
    """Per slice of the axis, how many cells (.., v) meet the predicate (by default: have a value)."""
    return cells.groupBy(axis).agg(F.count_if(m.value("v").isNotNull() if predicate is None else predicate).alias("n"))


def bad_slices(cells: DataFrame, axis: str, predicate: Column | None = None, cutoff: int = 0, good: bool = False) -> DataFrame:
    c = entry_counts(cells, axis, predicate)
    return c.where(F.col("n") > cutoff if good else F.col("n") <= cutoff).select(axis)


def robust_cells(cells: DataFrame, axes: list[str], cutoff: int = 0, predicate: Column | None = None) -> DataFrame:
    """Cells left after slices with cutoff or fewer valid cells are dropped, along each axis, until none is. Each round drops
    a cell at least; its result is written to the shared folder, so that the plan doesn't grow."""
    before = -1
    while True:
        for a in axes:
            cells = cells.join(bad_slices(cells, a, predicate, cutoff, good=True), a, "left_semi")
        cells = materialized(cells)
        now = cells.count()
        if now == before:
            return cells
        before = now


def slice_masks(cells: DataFrame, axes: list[str], sizes: dict[str, int], predicate: Column | None = None, cutoff: int = 0, good: bool = False) -> DataFrame:
    """(axis, place, masked) for every place of every axis (name: size): whether cutoff or fewer cells there are valid (with
    good: whether more are). Places without any cell have none."""
    out = None
    for a in axes:
        every = cells.sparkSession.range(sizes[a]).select(F.col("id").alias("place"))
        n = F.coalesce("n", F.lit(0))
        counts = entry_counts(cells, a, predicate).select(F.col(a).cast("long").alias("place"), "n")
        part = every.join(counts, "place", "left").select(F.lit(a).alias("axis"), "place", (n > cutoff if good else n <= cutoff).alias("masked"))
        out = part if out is None else out.union(part)
    return out


def robust_matrix(df: DataFrame, cols: list[str], low_count: int = 0, correlation: float | None = 0.99, priority: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rows left, [(dropped column, why)]): rows without any value and columns that are missing, low, zeros, constant, text,
    dates, the same as or correlated with an earlier one are dropped until no more are."""
    cols, gone = list(cols), []
    kinds = dict(df.dtypes)
    while cols:
        filled = F.greatest(*[(F.length(F.col(c)) > 0 if kinds[c] == "string" else F.col(c).isNotNull() if kinds[c][:4] in ("date", "time") else m.value(c).isNotNull()).cast("int") for c in cols], F.lit(0))
        df = df.where(filled == 1)
        bad = {}
        for r in profile(df, cols, low_count).collect():
            why = next((w for w in ("missing", "low", "zeros", "constant") if r[w]), None) or (r["kind"] if r["kind"] != "number" else None)
            if why:
                bad[r["name"]] = why
        if correlation is not None:
            left = [c for c in cols if c not in bad]
            bad |= {c: why for c, _, why in (redundant_columns(df, left, correlation, [c for c in priority or [] if c in left]) if len(left) > 1 else [])}
        if not bad:
            break
        gone += sorted(bad.items())
        cols = [c for c in cols if c not in bad]
    return df, gone


def record_range(cells: DataFrame, axis: str, along: str, predicate: Column) -> DataFrame:
    """First and last place along the other axis where the predicate holds, and the record's length."""
    a, b = F.min(F.when(predicate, F.col(along))), F.max(F.when(predicate, F.col(along)))
    return cells.groupBy(axis).agg(a.alias("first"), b.alias("last"), (b - a + 1).alias("length"))


def vector_profile(df: DataFrame, col: str) -> DataFrame:
    v = m.value(col)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.count_distinct(v).alias("kinds"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negative"), F.min(v).alias("least"), F.max(v).alias("largest"))


def rectangular(counts: DataFrame, axis: str, order: str) -> DataFrame:
    """Per axis slice, whether two neighbouring cells (order, n) are both filled."""
    from pyspark.sql import Window

    w = Window.partitionBy(axis).orderBy(order)
    both = (F.col("n") > 0) & (F.coalesce(F.lag("n").over(w), F.lit(0)) > 0)
    return counts.withColumn("_b", both).groupBy(axis).agg(F.bool_or("_b").alias("dense"))


def row_profile(df: DataFrame, key: str, cols: list[str], low_count: int = 0) -> DataFrame:
    """(key, n, missing, low, zeros, negative, constant, boolean) of each row's values; row by row."""
    values = F.filter(F.array(*[m.value(c) for c in cols]), lambda x: x.isNotNull())
    d = df.select(key, values.alias("_v")).withColumn("n", F.size("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    some, low = F.col("n") > 0, F.exists("_v", lambda x: x < 0)
    return d.select(key, "n", (F.col("n") == 0).alias("missing"), (some & (F.col("n") <= low_count)).alias("low"), (some & (total == 0)).alias("zeros"), low.alias("negative"), (some & (F.array_min("_v") == F.array_max("_v"))).alias("constant"), (some & ~F.exists("_v", lambda x: (x != 0) & (x != 1))).alias("boolean"))
