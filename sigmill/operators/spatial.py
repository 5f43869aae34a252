"""Spatial operators: interpolation on grids, polygons and hulls, spacing, map tiles as GeoJSON."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import missing as m
from ..sources.store import bounded, materialized


def largest_at_point(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row a coordinate, with its largest value."""
    return df.groupBy(x, y).agg(F.max(m.value(z)).alias(z))


def grid_points(df: DataFrame, x: str, y: str, nx: int, ny: int, margin: float = 0.0) -> DataFrame:
    """(gx, gy) of a regular grid over the points' box, widened by a share of its sides."""
    box = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = df.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    g = at.crossJoin(F.broadcast(box))
    def place(k, n, a, b):
        pad = (F.col(b) - F.col(a)) * margin
        return F.col(a) - pad + F.col(k) * (F.col(b) - F.col(a) + 2 * pad) / max(n - 1, 1)
    return g.select("i", "j", place("i", nx, "x0", "x1").alias("gx"), place("j", ny, "y0", "y1").alias("gy"))


def inverse_distance(points: DataFrame, grid: DataFrame, x: str, y: str, z: str, power: float = 2.0, smoothing: float = 0.0, neighbours: int | None = None) -> DataFrame:
    """(i, j, gx, gy, value): mean of z weighted by 1 / distance^power; a point at the place itself decides.

    The grid is the small side and is broadcast against the points; with neighbours only so many nearest count, picked
    by a window over each grid point.
    """
    d = F.sqrt(F.pow(F.col(x) - F.col("gx"), 2) + F.pow(F.col(y) - F.col("gy"), 2) + smoothing**2)
    pairs = points.where(m.value(z).isNotNull()).select(x, y, z).crossJoin(bounded(grid)).withColumn("_d", d)
    if neighbours:
        w = Window.partitionBy("i", "j").orderBy("_d", x, y)
        pairs = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= neighbours)
    weight = F.when(F.col("_d") > 0, 1 / F.pow(F.when(F.col("_d") > 0, F.col("_d")), power))
    exact = F.avg(F.when(F.col("_d") == 0, F.col(z)))
    return pairs.groupBy("i", "j", "gx", "gy").agg(F.coalesce(exact, F.sum(weight * F.col(z)) / F.sum(weight)).alias("value"))


def nearest_distances(points: DataFrame, x: str, y: str, key: str, cells: int = 64) -> DataFrame:
    """(k, d): each point's distance to the nearest other one, by a join on neighbouring grid cells, which widens until it
    covers all of them for the points that are left. A single point has none."""
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).crossJoin(F.broadcast(box))
    size = F.greatest((F.col("x1") - F.col("x0")) / cells, (F.col("y1") - F.col("y0")) / cells, F.lit(1e-12))
    at = at.select("k", "x", "y", F.floor((F.col("x") - F.col("x0")) / size).alias("cx"), F.floor((F.col("y") - F.col("y0")) / size).alias("cy"), size.alias("size"))
    found, left, reach = None, at, 1
    while True:
        spread = left.select("k", "x", "y", "size", F.explode(F.sequence(F.col("cx") - reach, F.col("cx") + reach)).alias("cx"), "cy").withColumn("cy", F.explode(F.sequence(F.col("cy") - reach, F.col("cy") + reach)))
        other = at.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
        near = spread.join(other, ["cx", "cy"]).where("k <> k2").groupBy("k").agg(F.min(F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))).alias("d"), F.max("size").alias("size"))
        near = materialized(near)  # used three times, and by every wider round
        sure = near.where(F.col("d") <= F.col("size") * reach).select("k", "d")  # no nearer point can lie outside the cells
        found = sure if found is None else found.union(sure)
        left = left.join(sure, "k", "left_anti")
        reach *= 4
        if not left.limit(1).count():
            return found
        if reach > 2 * cells:  # the last join covered every cell
            return found.union(left.join(near, "k").select("k", "d"))


def nearest_spacing(points: DataFrame, x: str, y: str, key: str, cells: int = 64, quantile: float = 0.5) -> DataFrame:
    """(spacing): a quantile of the distance to the nearest other point."""
    return nearest_distances(points, x, y, key, cells).agg(F.percentile("d", quantile).alias("spacing"))


#: Coordinate ranges in degrees at zoom 19, 18, .. 0.
ZOOM_RANGES = (0.0007, 0.0014, 0.003, 0.006, 0.012, 0.024, 0.048, 0.096, 0.192, 0.3712, 0.768, 1.536, 3.072, 6.144, 11.8784, 23.7568, 47.5136, 98.304, 190.0544, 360.0)


def zoom_level(df: DataFrame, x: str, y: str) -> float:
    """The zoom at which the points' larger side fits, linear between the ranges; outside them an error."""
    r = df.agg((F.max(m.value(x)) - F.min(m.value(x))).alias("a"), (F.max(m.value(y)) - F.min(m.value(y))).alias("b")).first()
    side = max(v for v in (r["a"], r["b"]) if v is not None)
    if not ZOOM_RANGES[0] <= side <= ZOOM_RANGES[-1]:
        raise ValueError(f"no zoom for a range of {side} degrees")
    return float(np.interp(side, ZOOM_RANGES, np.arange(19.0, -1, -1)))


def dot_size(df: DataFrame, x: str, y: str, zoom: float) -> float:
    """3 and half of the mean distance to the nearest other place times zoom cubed, rounded up."""
    places = df.where(m.value(x).isNotNull() & m.value(y).isNotNull()).select(x, y).distinct().withColumn("_key", F.xxhash64(x, y))
    mean = nearest_distances(places, x, y, "_key").agg(F.avg("d")).first()[0]
    return 3 + math.ceil(mean * zoom**3) / 2


def in_polygon(x, y, corners: list[tuple[float, float]]):
    """Ray casting as an expression over the corners."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    odd = F.lit(False)
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1]):
        if ya != yb:
            crosses = ((F.lit(float(ya)) > y) != (F.lit(float(yb)) > y)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
            odd = odd != crosses
    return odd


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the leftmost point."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 1e-12 * math.dist(out[-2], out[-1]) * math.dist(out[-2], p):
                out.pop()  # a corner must turn by more than rounding does
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def convex_hull(df: DataFrame, x: str, y: str) -> DataFrame:
    """(place, x, y): hulls of the partitions, then the hull of those corners, which are few."""
    def part(batches):
        for pdf in batches:
            h = hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist())))
            yield pd.DataFrame(h, columns=["x", "y"])

    def last(pdf):
        h = hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist())))
        return pd.DataFrame([(i, *p) for i, p in enumerate(h)], columns=["place", "x", "y"])

    parts = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").mapInPandas(part, "x double, y double")
    return parts.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(last, "place int, x double, y double")


def segments_cross(a, b, c, d, eps: float = 1e-12) -> bool:
    s = lambda v: 0 if abs(v) <= eps else (1 if v > 0 else -1)
    on = lambda p, q, r: min(p[0], q[0]) - eps <= r[0] <= max(p[0], q[0]) + eps and min(p[1], q[1]) - eps <= r[1] <= max(p[1], q[1]) + eps
    t = [s(turn(a, b, c)), s(turn(a, b, d)), s(turn(c, d, a)), s(turn(c, d, b))]
    if t[0] != t[1] and t[2] != t[3]:
        return True
    return any(not v and on(*p) for v, p in zip(t, ((a, b, c), (a, b, d), (c, d, a), (c, d, b))))


def self_crossing(corners: list[tuple[float, float]]) -> bool:
    n = len(corners)
    edges = [(corners[i], corners[(i + 1) % n]) for i in range(n)]
    return any(segments_cross(*edges[i], *edges[j]) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1))


def expanded(corners: list[tuple[float, float]], share: float = 0.05, margin: float | None = None) -> list[tuple[float, float]]:
    """Corners pushed away from their centre, by a share of their distance to it or by a margin."""
    cx, cy = sum(p[0] for p in corners) / len(corners), sum(p[1] for p in corners) / len(corners)
    if margin is not None:
        far = [max(math.hypot(x - cx, y - cy), 1e-300) for x, y in corners]
        return [(x + margin * (x - cx) / d, y + margin * (y - cy) / d) for (x, y), d in zip(corners, far)]
    return [(cx + (x - cx) * (1 + share), cy + (y - cy) * (1 + share)) for x, y in corners]


def cell_edges(centres: list[float]) -> list[float]:
    """Half way between centres, and as far outside the ends."""
    if len(centres) == 1:
        return [centres[0] - 0.5, centres[0] + 0.5]
    mid = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return [2 * centres[0] - mid[0], *mid, 2 * centres[-1] - mid[-1]]


def geojson_tiles(grid: DataFrame, dx: float, dy: float, mask: list[tuple[float, float]] | None = None) -> DataFrame:
    """(id, feature): each grid cell (i, j, gx, gy, value) as a GeoJSON polygon; mask keeps cells whose centre is inside."""
    g = grid.where(in_polygon("gx", "gy", mask)) if mask else grid
    x0, x1, y0, y1 = F.col("gx") - dx / 2, F.col("gx") + dx / 2, F.col("gy") - dy / 2, F.col("gy") + dy / 2
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    name = F.concat_ws("_", "i", "j")
    feature = F.struct(F.lit("Feature").alias("type"), name.alias("id"), F.struct(F.col("value")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return g.select(name.alias("id"), F.to_json(feature).alias("feature"))


def round_number(v: float, nearest: bool) -> float:
    """v as 1, 2, 5 or 10 times a power of ten, the nearest or the next one up."""
    if v <= 0:
        return 0.0
    power = 10.0 ** math.floor(math.log10(v))
    f = v / power
    steps = ((1.5, 1), (3, 2), (7, 5)) if nearest else ((1, 1), (2, 2), (5, 5))
    for top, out in steps:
        if f < top or not nearest and f <= top:
            return out * power
    return 10 * power


def round_bounds(low: float, high: float, ticks: int = 5, keep_low: bool = False, keep_high: bool = False) -> tuple[float, float]:
    """Bounds at round steps around [low, high], but for those to be kept; an empty range stays."""
    if not (math.isfinite(low) and math.isfinite(high)) or high <= low:
        return low, high
    step = round_number(round_number(high - low, False) / (max(ticks, 2) - 1), True)
    a, b = math.floor(low / step) * step, math.ceil(high / step) * step
    b = a + step if b <= a else b
    a, b = low if keep_low else a, high if keep_high else b
    return a, a + step if b <= a else b


def color_bounds(df: DataFrame, col: str, low: float | None = None, high: float | None = None, ticks: int = 5, nice: bool = True) -> tuple[float, float]:
    """Bounds of a color scale: the stated ones, kept, or round ones around the values; an empty range is widened."""
    got = df.agg(F.min(m.finite(col)).alias("a"), F.max(m.finite(col)).alias("b")).first()
    known = lambda v: v is not None and math.isfinite(v)
    keep_low, keep_high = known(low), known(high)
    if not keep_low:
        low = got["a"] if got["a"] is not None else high - max(1e-6, abs(high) * math.ulp(high)) if keep_high else 0.0
    if not keep_high:
        high = got["b"] if got["b"] is not None else low + 1.0
    if high <= low:
        high, keep_high = low + (max(1e-9, abs(low) * math.ulp(low))), False
    return round_bounds(float(low), float(high), ticks, keep_low, keep_high) if nice else (float(low), float(high))


def tick_values(low: float, high: float, count: int = 5) -> list[float]:
    return [float(v) for v in np.linspace(low, high, count)]


def contour_map(df: DataFrame, x: str, y: str, z: str, resolution: int = 50, neighbours: int | None = None, power: float = 2.0, padding: float = 0.05) -> DataFrame:
    """GeoJSON tiles of z interpolated inside the points' padded hull; 32 neighbours from 2000 points on, unless stated."""
    points = materialized(largest_at_point(df, x, y, z))
    if neighbours is None and points.count() >= 2000:
        neighbours = 32
    corners = [(r["x"], r["y"]) for r in convex_hull(points, x, y).orderBy("place").collect()]
    grid = grid_points(points, x, y, resolution, resolution)
    box = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    values = inverse_distance(points, grid, x, y, z, power, neighbours=neighbours)
    return geojson_tiles(values, (box[1] - box[0]) / max(resolution - 1, 1), (box[3] - box[2]) / max(resolution - 1, 1), expanded(corners, padding))


def densified(corners: list[tuple[float, float]], step: float) -> list[tuple[float, float]]:
    """The polygon's outline as points at most step apart."""
    out = []
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1]):
        n = max(1, math.ceil(math.hypot(xb - xa, yb - ya) / step))
        out += [(xa + (xb - xa) * i / n, ya + (yb - ya) * i / n) for i in range(n)]
    return out


def near_outline(df: DataFrame, x: str, y: str, key: str, corners: list[tuple[float, float]], distance: float, most: int = 100, least: int = 0) -> DataFrame:
    """The points within distance of the polygon's outline: the nearest most of them, and at least so many nearest ones."""
    d = None
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1]):
        long = (xb - xa) ** 2 + (yb - ya) ** 2
        s = F.lit(0.0) if long == 0 else F.greatest(F.least(((F.col(x) - xa) * (xb - xa) + (F.col(y) - ya) * (yb - ya)) / long, F.lit(1.0)), F.lit(0.0))
        e = F.sqrt(F.pow(F.col(x) - (xa + s * (xb - xa)), 2) + F.pow(F.col(y) - (ya + s * (yb - ya)), 2))
        d = e if d is None else F.least(d, e)
    ranked = df.withColumn("outline_distance", d).orderBy("outline_distance", key).limit(max(most, least))
    w = Window.orderBy("outline_distance", key)
    return ranked.withColumn("_r", F.row_number().over(w)).where((F.col("outline_distance") <= distance) | (F.col("_r") <= least)).drop("_r")


def concave_hull(points: list[tuple[float, float]], longest: float = 2.0) -> list[tuple[float, float]]:
    """Corners, counter-clockwise: the convex hull whose edges over ``longest`` times the median spacing of the points are
    bent inwards to the point nearest to them, as long as no edges cross. Of few points (thin others first), as it looks
    at each point for each edge. With fewer than four points, or if edges cross in the end, the convex hull."""
    pts = sorted(set(map(tuple, points)))
    ring = hull(pts)
    if len(pts) < 4 or len(ring) < 3:
        return ring
    at = np.array(pts)
    near = np.array([np.partition(np.hypot(*(at - p).T), 1)[1] for p in at])
    limit = longest * float(np.median(near))
    used, i = set(ring), 0
    while i < len(ring):
        a, b = ring[i], ring[(i + 1) % len(ring)]
        side = math.dist(a, b)
        best = None
        if side > limit:
            for p in pts:
                if p in used:
                    continue
                share = ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / side**2
                if 0 < share < 1:
                    away = abs(turn(a, b, p)) / side
                    if away < side and (best is None or (away, p) < best):
                        best = (away, p)
        if best is not None and max(math.dist(a, best[1]), math.dist(best[1], b)) < side:
            p = best[1]
            others = [(ring[j], ring[(j + 1) % len(ring)]) for j in range(len(ring)) if j != i]
            if not any(segments_cross(a, p, c, d) for c, d in others if a not in (c, d)) and not any(segments_cross(p, b, c, d) for c, d in others if b not in (c, d)):
                ring.insert(i + 1, p)
                used.add(p)
                continue
        i += 1
    return ring


def within_reach(grid: DataFrame, points: DataFrame, x: str, y: str, distance: float) -> DataFrame:
    """The grid's cells (gx, gy) with a point no farther than distance: an equi-join on squares of that side."""
    square = lambda c: F.floor(F.col(c) / distance)
    spread = grid.withColumns({"_cx": F.explode(F.sequence(square("gx") - 1, square("gx") + 1)), "_y": square("gy")}).withColumn("_cy", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)))
    near = points.select(F.col(x).alias("_px"), F.col(y).alias("_py"), square(x).alias("_cx"), square(y).alias("_cy")).where("_px is not null and _py is not null").distinct()
    close = F.pow(F.col("gx") - F.col("_px"), 2) + F.pow(F.col("gy") - F.col("_py"), 2) <= distance**2
    hit = spread.join(near, ["_cx", "_cy"]).where(close).select("i", "j").distinct()
    return grid.join(hit, ["i", "j"], "left_semi")


def valid_points(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """The rows, with their labels, whose place and value are finite."""
    return df.where(m.finite(x).isNotNull() & m.finite(y).isNotNull() & m.finite(z).isNotNull())
