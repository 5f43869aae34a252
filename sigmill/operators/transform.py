"""Table transforms: normalization and its inverses, masks, imputation, re-insertion, remapping, coercion, reshaping.

Functions take a DataFrame and column names and return a DataFrame with the other columns unchanged. Extremes come
from one aggregate, joined as a single broadcast row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import missing as m
from ..sources.store import bounded


def with_stats(df: DataFrame, stats: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with aggregates over all rows, or over the rows that agree in by."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in stats.items()])))
    return df.join(df.groupBy(*by).agg(*[c.alias(k) for k, c in stats.items()]), by)


def minmax(df: DataFrame, cols: list[str], reverse: bool = False, constant: str = "zero", by: list[str] | None = None, shared: bool = False) -> DataFrame:
    """Columns scaled to [0, 1]; shared: by one range for all of them.

    constant: what a column without spread becomes, 'zero' or (as whole-array scaling does) 'one'.
    """
    stats = {f"_{k}_{c}": f(c) for c in cols for k, f in (("lo", m.smallest), ("hi", m.largest))}
    out = with_stats(df, stats, by)
    lo = lambda c: F.least(*[F.col(f"_lo_{x}") for x in cols]) if shared and len(cols) > 1 else F.col(f"_lo_{c}")
    hi = lambda c: F.greatest(*[F.col(f"_hi_{x}") for x in cols]) if shared and len(cols) > 1 else F.col(f"_hi_{c}")
    new = {}
    for c in cols:
        flat = hi(c) == lo(c)
        low = F.when(flat, 0.0).otherwise(lo(c)) if constant == "one" else lo(c)
        span = F.when(~flat, hi(c) - lo(c)).otherwise(F.when(hi(c) != 0, hi(c)).otherwise(1.0) if constant == "one" else F.lit(1.0))
        new[c] = (hi(c) - m.value(c)) / span if reverse else (m.value(c) - low) / span
    return out.withColumns(new).drop(*stats)


def minmax_rows(df: DataFrame, cols: list[str], reverse: bool = False) -> DataFrame:
    """Each row's values scaled by the row's own range."""
    values = F.array(*[m.value(c) for c in cols])
    out = df.withColumn("_lo", F.array_min(values)).withColumn("_hi", F.array_max(values))
    span = F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return out.withColumns({c: ((F.col("_hi") - m.value(c)) if reverse else (m.value(c) - F.col("_lo"))) / span for c in cols}).drop("_lo", "_hi")


def denormalize(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Undo minmax with the (low, high) of each column."""
    return df.withColumns({c: F.col(c) * (hi - lo) + lo for c, (lo, hi) in ranges.items()})


def log_scaled(df: DataFrame, col: str, offset: float = 1.0) -> DataFrame:
    """col's log10 scaled to [0, 1]; adds log_kind ('none', 'shift', 'min_zero', 'absflip', 'absflip_min_zero'), log_shift, log_lo, log_hi.

    All values under or at 0: absolute values. Both signs: shifted by |min| + offset. Zeros: offset below the smallest log.
    """
    v = m.value(col)
    out = with_stats(df, {"_pos": F.count_if(v > 0), "_neg": F.count_if(v < 0), "_lo": F.min(v)})
    x = F.when(F.col("_pos") == 0, F.abs(v)).when(F.col("_neg") > 0, v + F.abs(F.col("_lo")) + offset).otherwise(v)
    out = out.withColumn("_x", x)
    out = with_stats(out, {"_zeros": F.count_if(F.col("_x") == 0), "_least": F.min(F.log10(F.when(F.col("_x") > 0, F.col("_x"))))})
    y = F.when(F.col("_x") > 0, F.log10(F.when(F.col("_x") > 0, F.col("_x")))).when(F.col("_x") == 0, F.col("_least") - offset)
    out = with_stats(out.withColumn("_y", y), {"log_lo": F.min("_y"), "log_hi": F.max("_y")})
    kind = F.when(F.col("_pos") == 0, F.when(F.col("_zeros") > 0, "absflip_min_zero").otherwise("absflip")).when(F.col("_zeros") > 0, "min_zero").when(F.col("_neg") > 0, "shift").otherwise("none")
    span = F.when(F.col("log_hi") > F.col("log_lo"), F.col("log_hi") - F.col("log_lo")).otherwise(1.0)
    shift = F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.abs(F.col("_lo")) + offset).otherwise(0.0)
    return out.withColumns({"log_kind": kind, "log_shift": shift, col: (F.col("_y") - F.col("log_lo")) / span}).drop("_pos", "_neg", "_lo", "_x", "_zeros", "_least", "_y")


def log_unscaled(df: DataFrame, col: str) -> DataFrame:
    """Undo log_scaled by the columns it added."""
    span = F.when(F.col("log_hi") > F.col("log_lo"), F.col("log_hi") - F.col("log_lo")).otherwise(1.0)
    y = F.col(col) * span + F.col("log_lo")
    zero = F.col("log_kind").isin("min_zero", "absflip_min_zero") & (F.abs(y - F.col("log_lo")) < 1e-12)
    x = F.when(zero, 0.0).otherwise(F.pow(F.lit(10.0), y))
    back = F.when(F.col("log_kind").startswith("absflip"), -x).otherwise(x - F.col("log_shift"))
    return df.withColumn(col, back).drop("log_kind", "log_shift", "log_lo", "log_hi")


def over_largest(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns divided by their largest value; one without a positive spread from 0 is left alone."""
    stats = {f"_hi_{c}": m.largest(c) for c in cols}
    return with_stats(df, stats, by).withColumns({c: F.when(F.coalesce(F.col(f"_hi_{c}"), F.lit(0.0)) != 0, m.value(c) / F.col(f"_hi_{c}")).otherwise(m.value(c)) for c in cols}).drop(*stats)


def over_largest_in_row(df: DataFrame, cols: list[str]) -> DataFrame:
    top = F.array_max(F.array(*[m.value(c) for c in cols]))
    return df.withColumn("_top", top).withColumns({c: F.when(F.coalesce(F.col("_top"), F.lit(0.0)) != 0, m.value(c) / F.col("_top")).otherwise(m.value(c)) for c in cols}).drop("_top")


def reflect(df: DataFrame, cols: list[str]) -> DataFrame:
    """-x + max + min: the range turned around."""
    stats = {f"_{k}_{c}": f(c) for c in cols for k, f in (("lo", m.smallest), ("hi", m.largest))}
    return with_stats(df, stats).withColumns({c: F.col(f"_hi_{c}") + F.col(f"_lo_{c}") - m.value(c) for c in cols}).drop(*stats)


def mask_at_most(df: DataFrame, cols: list[str], limit: float) -> DataFrame:
    """Values of limit or less become missing."""
    return df.withColumns({c: F.when(m.value(c) > limit, m.value(c)) for c in cols})


def mask_rows(df: DataFrame, mask: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Values of rows whose key is in mask become missing."""
    marked = df.join(mask.select(*on).distinct().withColumn("_m", F.lit(True)), on, "left")
    return marked.withColumns({c: F.when(F.col("_m").isNull(), F.col(c)) for c in cols}).drop("_m")


def floor_at(df: DataFrame, cols: list[str], least: float = 2.220446049250313e-16**2) -> DataFrame:
    return df.withColumns({c: F.greatest(m.value(c), F.when(m.value(c).isNotNull(), F.lit(least))) for c in cols})


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values become the column's mean, 0 if it has no value."""
    stats = {f"_mean_{c}": m.mean(c) for c in cols}
    return with_stats(df, stats).withColumns({c: F.coalesce(m.value(c), F.col(f"_mean_{c}"), F.lit(0.0)) for c in cols}).drop(*stats)


def reinsert_rows(kept: DataFrame, all_keys: DataFrame, on: list[str], fill: float | None = None) -> DataFrame:
    """Rows that a filter took out come back, their values fill."""
    out = all_keys.select(*on).join(kept.withColumn("_there", F.lit(True)), on, "left")
    return out.withColumns({c: F.when(F.col("_there"), F.col(c)).otherwise(F.lit(fill)) for c in kept.columns if c not in on}).drop("_there")


def reinsert_columns(df: DataFrame, order: list[str], fill: float | None = None) -> DataFrame:
    """The columns in the given order, those that df lacks filled."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).cast("double").alias(c) for c in order])


def gather(values: DataFrame, mapping: DataFrame, idx: str, target: str, source: str, cols: list[str]) -> DataFrame:
    """For each row of mapping (target, source) the values at index source; missing where source is."""
    picked = values.select(F.col(idx).alias(source), *cols)
    return mapping.select(target, source).join(picked, source, "left").select(target, *cols)


def interpolate(points: DataFrame, wanted: DataFrame, x: str, y: str, by: list[str] | None = None, nonnegative: bool = True) -> DataFrame:
    """y at wanted x, linear between points and, at the ends, along the first or last segment."""
    by = by or []
    w = Window.partitionBy(*by, F.lit(0)).orderBy(x)
    known = points.select(*by, x, y).where(m.value(y).isNotNull())
    seg = known.withColumns({"_x2": F.lead(x).over(w), "_y2": F.lead(y).over(w), "_first": F.lag(x).over(w).isNull(), "_last": F.lead(x, 2).over(w).isNull()}).where("_x2 is not null")
    seg = seg.select(*by, F.col(x).alias("_x1"), F.col(y).alias("_y1"), "_x2", "_y2", "_first", "_last")
    hit = ((F.col(x) >= F.col("_x1")) | F.col("_first")) & ((F.col(x) < F.col("_x2")) | F.col("_last"))
    both = wanted.join(seg, by) if by else wanted.crossJoin(bounded(seg))
    v = F.col("_y1") + (F.col(x) - F.col("_x1")) / (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    return both.where(hit).select(*by, x, (F.greatest(v, F.lit(0.0)) if nonnegative else v).alias(y))


def coerce(df: DataFrame, cols: list[str], negatives: bool = True, keep_text: bool = False) -> DataFrame:
    """Mixed text to numbers; without negatives those become 0; keep_text leaves what isn't a number as text."""
    new = {}
    for c in cols:
        v = m.parsed(c)
        v = v if negatives else F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))
        new[c] = F.when(v.isNull() & ~F.trim(F.col(c)).isin("", "NaN"), F.col(c)).otherwise(v.cast("string")) if keep_text else v
    return df.withColumns(new)


def rename(df: DataFrame, names: dict[str, str], match: str = "exact") -> DataFrame:
    """Columns renamed where they equal, start with or end with a key; the longest key wins."""
    new = []
    for c in df.columns:
        fits = [k for k in names if c == k or match == "start" and c.startswith(k) or match == "end" and c.endswith(k)]
        new.append(names[max(fits, key=len)] if fits else c)
    return df.toDF(*new)


def unfold(cells: DataFrame, axes: list[str], keep: str, value: str = "v", mask: DataFrame | None = None) -> DataFrame:
    """Cells of an N-dimensional array to (row, col, value): keep is the column axis, the others make the row, the first fastest.
    mask (some of the axes): cells at its places are left out; the rows' numbers don't change."""
    rest = [a for a in axes if a != keep]
    sizes = cells.agg(*[(F.max(a) + 1).alias(f"_n_{a}") for a in rest])
    row, step = F.lit(0).cast("long"), F.lit(1).cast("long")
    for a in rest:
        row, step = row + F.col(a) * step, step * F.col(f"_n_{a}")
    if mask is not None:
        cells = cells.join(mask.distinct(), [a for a in axes if a in mask.columns], "left_anti")
    return cells.crossJoin(F.broadcast(sizes)).select(row.alias("row"), F.col(keep).alias("col"), F.col(value))


def to_cells(df: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """Wide rows to (i, j, v) with j the column's place; missing values give no cell."""
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), m.value(c).alias("v")) for j, c in enumerate(cols)]))
    return df.select(F.col(row).alias("i"), pairs.alias("_c")).select("i", "_c.j", "_c.v").where("v is not null")


def name_products(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Every 'x:y'; both sides are lists of names, so small."""
    return a.select(x).distinct().crossJoin(bounded(b.select(y).distinct())).select(F.concat_ws(":", x, y).alias("name"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda p, q: p | q, columns)


def minmax_auto_log(cells: DataFrame, axis: str, min_skewness: float = 1.0, min_log_range: float = 1.5, offset: float = 1.0) -> DataFrame:
    """Cells (.., v) scaled to [0, 1] in each slice of the axis, after log10 where the slice is skewed or spans decades; adds logged.

    A slice without spread becomes 1 (0 if it is 0). Values not over 0 take the smallest log minus offset.
    """
    v = m.value("v")
    out = with_stats(cells, {"_sk": F.skewness(v), "_a": F.min(v), "_b": F.max(v), "_least": F.min(F.log10(F.when(v > 0, v)))}, [axis])
    wide = F.when(F.col("_a") > 0, F.log10(F.when(F.col("_b") > 0, F.col("_b"))) - F.log10(F.when(F.col("_a") > 0, F.col("_a"))) > min_log_range).otherwise(F.col("_b") > 0)
    logged = F.coalesce((F.nanvl(F.col("_sk"), F.lit(0.0)) > min_skewness) | wide, F.lit(False))
    y = F.when(~logged, v).when(v > 0, F.log10(F.when(v > 0, v))).when(v.isNotNull(), F.col("_least") - offset)
    out = out.withColumns({"logged": logged, "v": y}).drop("_sk", "_a", "_b", "_least")
    return minmax(out, ["v"], constant="one", by=[axis])


def mask_mixers(w: DataFrame, cells: DataFrame) -> DataFrame:
    """W (i, k, w) with weights missing for rows i that have no value in cells (i, j, v)."""
    seen = cells.where(m.value("v").isNotNull()).select("i").distinct().withColumn("_s", F.lit(True))
    return w.join(seen, "i", "left").withColumn("w", F.when(F.col("_s"), F.col("w"))).drop("_s")


def lonlat_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """The columns that look like longitude and latitude."""
    import re

    find = lambda pattern: next((c for c in df.columns if re.match(pattern, c, re.I)), None)
    return find(r"(lon|lng|long|longitude|x)([^a-z]|$)"), find(r"(lat|latitude|y)([^a-z]|$)")


def text_or_missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("missing"))


def axis_order(sizes: tuple[int, ...], target: tuple[int, ...]) -> list[int]:
    """A permutation of axes that turns sizes into target; each axis is used once, ties from the left."""
    free, out = list(range(len(sizes))), []
    for n in target:
        i = next((a for a in free if sizes[a] == n), None)
        if i is None:
            raise ValueError(f"{sizes} can't be ordered as {target}")
        free.remove(i)
        out.append(i)
    return out


def log10_safe(df: DataFrame, col: str, offset: float = 1.0) -> DataFrame:
    """log10 of positive values, others offset under the smallest of them; if no value is positive, log10 of the sizes (0: -Infinity)."""
    v = m.value(col)
    logs = F.log10(F.when(v > 0, v))
    stats = {"_least": F.min(logs)}
    sizes = F.when(v == 0, F.lit(float("-inf"))).otherwise(F.log10(F.when(v != 0, F.abs(v))))
    out = F.when(F.col("_least").isNull(), sizes).when(v > 0, logs).when(v.isNotNull(), F.col("_least") - offset)
    return with_stats(df, stats).withColumn(col, out).drop("_least")


def denormalize_rows(df: DataFrame, cols: list[str], low: str, high: str) -> DataFrame:
    """Undo minmax_rows with each row's low and high; a row without spread has a range of 1."""
    span = F.when(F.col(high) != F.col(low), F.col(high) - F.col(low)).otherwise(1.0)
    return df.withColumns({c: m.value(c) * span + F.col(low) for c in cols})


def slice_ranges(cells: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """(axes.., low, high) of the cells in each slice, for denormalize_cells."""
    return cells.groupBy(*axes).agg(m.smallest(value).alias("low"), m.largest(value).alias("high"))


def minmax_cells(cells: DataFrame, ranges: DataFrame, axes: list[str], value: str = "v", reverse: bool = False) -> DataFrame:
    """Cells scaled by their slice's range; ranges as of slice_ranges."""
    span = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    scaled = (F.col("high") - m.value(value)) if reverse else (m.value(value) - F.col("low"))
    return cells.join(ranges, axes).withColumn(value, scaled / span).drop("low", "high")


def denormalize_cells(cells: DataFrame, ranges: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Undo minmax_cells; slices without a range stay as they are."""
    span = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    back = F.when(F.col("low").isNull(), m.value(value)).otherwise(m.value(value) * span + F.col("low"))
    return cells.join(ranges, axes, "left").withColumn(value, back).drop("low", "high")


def descale(df: DataFrame, tops: dict[str, float]) -> DataFrame:
    """Undo over_largest with each column's largest value; 0 and missing ones leave the column alone."""
    return df.withColumns({c: m.value(c) * t for c, t in tops.items() if t})


def descale_rows(df: DataFrame, cols: list[str], top: str) -> DataFrame:
    """Undo over_largest_in_row with each row's largest value."""
    by = F.when(F.coalesce(F.col(top), F.lit(0.0)) != 0, F.col(top)).otherwise(1.0)
    return df.withColumns({c: m.value(c) * by for c in cols})


def descale_cells(cells: DataFrame, tops: DataFrame, axes: list[str], value: str = "v", top: str = "top") -> DataFrame:
    """Undo scaling by each slice's largest value; tops: (axes.., top)."""
    by = F.when(F.coalesce(F.col(top), F.lit(0.0)) != 0, F.col(top)).otherwise(1.0)
    return cells.join(tops.select(*axes, top), axes, "left").withColumn(value, m.value(value) * by).drop(top)


def repeat_mask(mask: DataFrame, new_axes: dict[str, int]) -> DataFrame:
    """A mask's places repeated along new axes of the given sizes."""
    for axis, size in new_axes.items():
        mask = mask.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1)))) if size else mask.where(F.lit(False)).withColumn(axis, F.lit(0))
    return mask


def flat_index(df: DataFrame, axes: dict[str, int], first_fastest: bool = True, labels: dict[str, str] | None = None, to: str = "row") -> DataFrame:
    """The place of a cell when the axes (name: size) are flattened, and with labels a text of 'label index' parts."""
    place, step = F.lit(0).cast("long"), 1
    for a, size in axes.items() if first_fastest else reversed(axes.items()):
        place, step = place + F.col(a) * F.lit(step), step * size
    out = df.withColumn(to, place)
    return out.withColumn(f"{to}_label", F.concat_ws(" ", *[F.concat(F.lit(f"{labels.get(a, a)} "), F.col(a).cast("string")) for a in axes])) if labels is not None else out
