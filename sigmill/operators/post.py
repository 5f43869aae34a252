"""Tables about chosen solutions: ranked members, clusters of rows and columns, signals' shares of the reconstruction."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

from ..sources.store import joined_path, write_csv

from .cluster import best_assignment, kmeans_range
from .factorize import factor_cells
from .order import signal_members, strongest_signal
from .reduce import reconstruction
from .transform import over_largest


@dataclass(frozen=True)
class Report:
    """ranking: (side, k, place, name, share); clusters: (side, name, label, signal); shares: (i, j, k, share); fits: (side, name, fit)."""

    ranking: DataFrame
    clusters: DataFrame
    shares: DataFrame
    fits: DataFrame


def repeats_for(rows: int, most: int = 1000) -> int:
    """Fewer restarts for more rows."""
    for limit, n in ((100_000, 1), (10_000, 10), (1_000, 100)):
        if rows > limit:
            return min(n, most)
    return most


def aggregated(x: DataFrame, groups: DataFrame) -> DataFrame:
    """x (name, k, v) summed over groups (name, group), under the group's name."""
    return x.join(groups, "name").groupBy(F.col("group").alias("name"), "k").agg(F.sum("v").alias("v"))


def _clusters(x: DataFrame, k: int, signals: int, repeats: int) -> DataFrame:
    """(name, label, signal): names clustered by their signal profile, and each label's own signal."""
    rows = x.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("vec"))
    _, found, _ = kmeans_range(rows, "vec", "name", [k], repeats)
    means = found.select(F.col("cluster"), F.posexplode("vec")).groupBy("cluster").pivot("pos", list(range(signals))).agg(F.avg("col")).orderBy("cluster").collect()
    table = [[r[str(q)] or 0.0 for q in range(signals)] for r in means]
    rows_, _ = best_assignment(table) if len(table) == signals else ([max(range(signals), key=lambda q: t[q]) for t in table], 0)
    pairs = F.create_map(*[F.lit(v) for i, r in enumerate(means) for v in (int(r["cluster"]), int(rows_[i]))])
    return found.select("name", F.char(F.lit(64) + F.col("cluster")).alias("label"), pairs[F.col("cluster")].alias("signal"))


def report(found: DataFrame, k: int, w_names: DataFrame, h_names: DataFrame, cells: DataFrame | None = None, cutoff: float = 0.5, repeats: int = 2) -> Report:
    """found: solutions; w_names (i, name), h_names (j, name); cells (i, j, v) of the data for the fits by name."""
    w, h = factor_cells(found, k)
    sides = {"W": w.join(w_names, "i").select("name", "k", F.col("w").alias("v")), "H": h.join(h_names, "j").select("name", "k", F.col("h").alias("v"))}
    rank = clusters = None
    for side, x in sides.items():
        x = over_largest(x, ["v"], ["k"])
        r = signal_members(x, cutoff).select(F.lit(side).alias("side"), "k", "place", "name", "share")
        n = x.select("name").distinct().count()
        c = _clusters(x, min(k, n), k, repeats) if k > 1 and n > k else strongest_signal(x).select("name", F.char(F.lit(65) + F.col("k")).alias("label"), F.col("k").alias("signal"))
        c = c.select(F.lit(side).alias("side"), "name", "label", "signal")
        rank, clusters = (r, c) if rank is None else (rank.union(r), clusters.union(c))
    parts = w.join(h, "k").select("i", "j", "k", (F.col("w") * F.col("h")).alias("p"))
    whole = parts.groupBy("i", "j").agg(F.sum("p").alias("_t"))
    shares = parts.join(whole, ["i", "j"]).select("i", "j", "k", F.coalesce(F.try_divide("p", "_t"), F.lit(0.0)).alias("share"))
    fits = None
    if cells is not None:
        both = cells.join(reconstruction(w, h).withColumnRenamed("v", "e"), ["i", "j"])
        for side, key, names in (("W", "i", w_names), ("H", "j", h_names)):
            err = both.groupBy(key).agg((F.sqrt(F.sum(F.pow(F.col("v") - F.col("e"), 2))) / F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(1e-300))).alias("fit"))
            one = err.join(names, key).select(F.lit(side).alias("side"), "name", "fit")
            fits = one if fits is None else fits.union(one)
    else:
        fits = rank.select("side", "name", F.lit(None).cast("double").alias("fit")).limit(0)
    return Report(rank, clusters, shares, fits)


def association(shares: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(i, j, signal, share): each cell's leading signal, where it reaches the cutoff."""
    top = shares.groupBy("i", "j").agg(F.max(F.struct("share", (-F.col("k")).alias("nk"))).alias("_m"))
    return top.select("i", "j", (-F.col("_m.nk")).alias("signal"), F.col("_m.share").alias("share")).where(F.col("share") >= cutoff)


@dataclass(frozen=True)
class PostOptions:
    """What reports() is asked for. An unknown name is an error, as is a name given twice with different values."""

    cutoff: float = 0.5
    repeats: int = 2
    result_dir: str | None = None
    w_case: str = "attributes"
    h_case: str = "locations"
    w_groups: DataFrame | None = None
    h_groups: DataFrame | None = None
    w_types: dict | None = None
    h_types: dict | None = None
    important: int = 30

    def but(self, **kw) -> PostOptions:
        return replace(self, **checked(kw))


def checked(values: dict) -> dict:
    """values, if all names are options."""
    bad = sorted(set(values) - {f.name for f in fields(PostOptions)})
    if bad:
        raise ValueError(f"unsupported options: {', '.join(bad)}")
    return values


def settings(options: PostOptions | dict | None, w_names: DataFrame, h_names: DataFrame, **kw) -> PostOptions:
    """Options with those stated over them, after a check of the names: each (place, name) once, none missing."""
    base = options if isinstance(options, PostOptions) else PostOptions(**checked(dict(options or {})))
    for names, place in ((w_names, "i"), (h_names, "j")):
        got = names.agg(F.count(F.lit(1)), F.count_distinct(place), F.count_distinct("name"), F.count("name")).first()
        if len(set(got)) > 1:
            raise ValueError(f"names by {place}: {got[0]} rows, {got[1]} places, {got[2]} names")
    return base.but(**kw)


def reports(found: DataFrame, ks: list[int], w_names: DataFrame, h_names: DataFrame, cells: DataFrame | None = None, options: PostOptions | dict | None = None, **kw) -> dict[int, Report]:
    """A report for each k in found; with result_dir the members, clusters and groups of each as CSV folders under it.

    w_groups and h_groups (name, group) sum rows of W or columns of H under the group's name in the clusters and members.
    """
    o = settings(options, w_names, h_names, **kw)
    there = {r["k"] for r in found.select("k").collect()}
    out = {}
    for k in [k for k in ks if k in there]:
        one = report(found, k, w_names, h_names, cells, o.cutoff, o.repeats)
        w, h = factor_cells(found, k)
        for side, x, groups in (("W", w.join(w_names, "i").select("name", "k", F.col("w").alias("v")), o.w_groups), ("H", h.join(h_names, "j").select("name", "k", F.col("h").alias("v")), o.h_groups)):
            if groups is not None:
                x = over_largest(aggregated(x, groups), ["v"], ["k"])
                members = signal_members(x, o.cutoff).select(F.lit(side).alias("side"), "k", "place", "name", "share")
                own = strongest_signal(x).select(F.lit(side).alias("side"), "name", F.char(F.lit(65) + F.col("k")).alias("label"), F.col("k").alias("signal"))
                one = Report(one.ranking.where(F.col("side") != side).union(members), one.clusters.where(F.col("side") != side).union(own), one.shares, one.fits)
        out[k] = one
        if o.result_dir:
            spark = found.sparkSession
            for side, case in (("W", o.w_case), ("H", o.h_case)):
                write_csv(one.ranking.where(F.col("side") == side).orderBy("k", "place"), joined_path(spark, o.result_dir, f"{case}-{k}-members"))
                clusters = one.clusters.where(F.col("side") == side)
                write_csv(clusters.orderBy("label", "name"), joined_path(spark, o.result_dir, f"{case}-{k}-clusters"))
                groups = clusters.groupBy("label").agg(F.concat_ws(";", F.array_sort(F.collect_list("name"))).alias("names"))  # one row a label
                write_csv(groups.orderBy("label"), joined_path(spark, o.result_dir, f"{case}-{k}-groups"))
    return out
