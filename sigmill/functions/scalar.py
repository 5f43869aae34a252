"""Row-wise formulas as Column expressions: logs, labels, text, geodesy, isotopes, decline curves, sampling points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .missing import value

EARTH_KM = 6372.8
#: NAD83 ellipsoid: semi-major axis in metres and flattening.
AXIS, FLAT = 6378137.0, 1 / 298.257222101


def c_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log10_floor(c, least_log: Column | float, offset: float = 1.0) -> Column:
    """log10 of positive values; others become least_log - offset, with least_log the smallest log10 of a positive one."""
    v = value(c)
    low = least_log if isinstance(least_log, Column) else F.lit(float(least_log))
    return F.when(v > 0, F.log10(F.when(v > 0, v))).when(v.isNotNull(), low - offset)


def cluster_letter(c, clusters: int) -> Column:
    """1, 2, .. as A, B, ..; with more than 30 clusters as T01, T02, .."""
    n = c_(c).cast("int")
    if clusters < 31:
        return F.char(F.lit(64) + n)
    return F.concat(F.lit("T"), F.lpad(n.cast("string"), len(str(clusters)), "0"))


def upper_at(c, i: int = 1) -> Column:
    s = c_(c)
    return F.concat(F.substring(s, 1, i - 1), F.upper(F.substring(s, i, 1)), F.substr(s, F.lit(i + 1)))


def safe_name(c) -> Column:
    """Text without characters that file names and markup mind."""
    s = F.regexp_replace(c_(c), "&", "and")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\(", "["), "<", "lt"), "–", "-")


def haversine(lat1, lon1, lat2, lon2, r: float = EARTH_KM) -> Column:
    a, b = F.radians(c_(lat1)), F.radians(c_(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(c_(lon2)) - F.radians(c_(lon1))) / 2), 2)
    return 2 * r * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def utm_zone(lon) -> Column:
    return (F.floor((c_(lon) + 180) / 6) + 1).cast("int")


def _krueger():
    n = FLAT / (2 - FLAT)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, a, forward, back, delta


def utm(lat, lon, zone) -> tuple[Column, Column]:
    """Easting and northing in metres (south: false northing 10,000 km), by Krueger's series."""
    n, a, alpha, _, _ = _krueger()
    lat_, d = F.radians(c_(lat)), F.radians(c_(lon) - (c_(zone) * 6 - 183))
    e = 2 * n**0.5 / (1 + n)
    s = F.sin(lat_)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * a * east, 0.9996 * a * north + F.when(c_(lat) < 0, 1e7).otherwise(0.0)


def utm_back(x, y, zone, north: bool = True) -> tuple[Column, Column]:
    """Latitude and longitude of UTM coordinates."""
    _, a, _, beta, delta = _krueger()
    xi, eta = (c_(y) - (0 if north else 1e7)) / (0.9996 * a), (c_(x) - 500_000) / (0.9996 * a)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (c_(zone) * 6 - 183)


def isotope_concentration(delta, standard: float, species, scale: float = 1.0) -> Column:
    ratio = (c_(delta) / 1000 + 1) * standard
    return c_(species) * ratio / (ratio + 1) * scale


def isotope_delta(isotope, standard: float, species, scale: float = 1.0) -> Column:
    ratio = F.try_divide(c_(isotope) * scale, c_(species) - c_(isotope))
    return (ratio - standard) / standard * 1000


def decline_hyperbolic(t, q0: float, d: float, b: float) -> Column:
    """q0 * (1 + b d t) ** (1 / b): the sign of the exponent is the modelled tool's, not the textbook's."""
    return q0 * F.pow(1 + b * d * c_(t), 1.0 / b)


def decline_exponential(t, q0: float, d: float) -> Column:
    return q0 * F.exp(-d * c_(t))


def decline_harmonic(t, q0: float, d: float) -> Column:
    """q0 * (1 + d t): multiplies, where the textbook divides."""
    return q0 * (1 + d * c_(t))


def recovery_hyperbolic(q0, d: float, b: float, qe: Column | None = None, qi: float = 0.0) -> Column:
    q0 = c_(q0)
    end = q0 / 1000 if qe is None else qe
    return qi + F.pow(q0, b) / ((1 - b) * d) * (F.pow(q0, 1 - b) - F.pow(end, 1 - b))


def recovery_exponential(q0, d: float, qi: float = 0.0) -> Column:
    return qi + c_(q0) / d


def recovery_harmonic(q0, d: float, qe: Column | None = None, qi: float = 0.0) -> Column:
    q0 = c_(q0)
    return qi + q0 / d * F.ln(q0 / (q0 / 10_000 if qe is None else qe))


def periodic_distance(x: list, y: list, periods: list[float], weights: list[float], p: float = 2.0) -> Column:
    """Weighted Minkowski distance in which each axis wraps around at its period."""
    total = F.lit(0.0)
    for a, b, t, w in zip(x, y, periods, weights):
        m = F.pmod(F.abs(c_(a) - c_(b)), F.lit(float(t)))
        total = total + w * F.pow(F.least(m, t - m), p)
    return F.pow(total, 1.0 / p)


def contour_level(c, low: float, high: float, levels: int) -> Column:
    """The value clamped to [low, high] and rounded to the nearest of levels steps, ties to even."""
    step = (high - low) / levels
    return low + F.rint((F.least(F.greatest(c_(c), F.lit(low)), F.lit(high)) - low) / step) * step


def spaced_points(n: int, total: float, start: float = 1.0) -> Column:
    """n evenly spaced inner points of [start, total] as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: start + (total - start) * i / (n + 1.0))


def hashed_uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) that depends on the seed and the keys only, not on how the data are partitioned."""
    h = F.xxhash64(F.lit(seed), *[c_(k) for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def random_points(spark, n: int, totals: list[float], starts: list[float] | None = None, seed: int = 1):
    """(id, p0, p1, ..): n points in a box, by hash of seed and id."""
    starts = starts or [1.0] * len(totals)
    return spark.range(n).select("id", *[(a + (b - a) * hashed_uniform(seed + 31 * q, "id")).alias(f"p{q}") for q, (a, b) in enumerate(zip(starts, totals))])


def latin_hypercube_points(spark, n: int, totals: list[float], starts: list[float] | None = None, seed: int = 1):
    """(id, p0, p1, ..): in each dimension one point in each of n equal strata, strata dealt by hash."""
    from pyspark.sql import Window

    starts = starts or [1.0] * len(totals)
    out = spark.range(n)
    for q, (a, b) in enumerate(zip(starts, totals)):
        stratum = F.row_number().over(Window.orderBy(hashed_uniform(seed + 101 * q, "id"), "id")) - 1  # n points are few
        out = out.withColumn(f"p{q}", a + (b - a) * (stratum + hashed_uniform(seed + 7 + 31 * q, "id")) / n)
    return out


def formatted(form: str, *cols) -> Column:
    """printf of columns."""
    return F.format_string(form, *[c_(c) for c in cols])


def _trimmed(text: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(F.instr(text, ".") == 0, text).when(cut == "", "0").otherwise(cut)


def decimal_label(c) -> Column:
    """Six decimals, ties away from zero, without trailing zeros."""
    return _trimmed(F.format_string("%.6f", c_(c).cast("double")))


def scientific_label(c) -> Column:
    """Four decimals of the mantissa without trailing zeros, 'e' and the exponent; 0 is '0'."""
    text = F.format_string("%.4e", c_(c).cast("double"))
    parts = F.split(text, "e")
    return F.when(c_(c) == 0, "0").otherwise(F.concat(_trimmed(parts[0]), F.lit("e"), parts[1].cast("int").cast("string")))


def tick_labels(df, col: str, to: str = "label"):
    """Labels of a column of ticks: all in scientific form if any is 1e4 or more, or under 1e-2 and not 0, in size."""
    size = F.abs(F.col(col))
    odd = df.agg(F.coalesce(F.bool_or((size >= 1e4) | ((size > 0) & (size < 1e-2))), F.lit(False)).alias("_odd"))
    return df.crossJoin(F.broadcast(odd)).withColumn(to, F.when(F.col("_odd"), scientific_label(col)).otherwise(decimal_label(col))).drop("_odd")
