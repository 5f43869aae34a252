"""Factorization of nonnegative matrices: ensembles of restarts in parallel, choice of the number of signals, tall data.

A matrix is given as rows (id, x array<double>) with missing cells as NULL or NaN.

* ``sweep`` sends one task a (k, run): the matrix is broadcast, which is only done under ``most_cells`` cells; taller
  data go through ``factorize_tall``.
* ``factorize_tall`` keeps rows distributed and H (k x m) on the driver; every iteration is one pass that updates the
  rows' weights and sums the k x m partials map-side, so what travels doesn't grow with the rows. The row state is
  written to the shared checkpoint folder every few iterations.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from ..functions import missing as m
from ..sources.store import materialized

MOST_CELLS = 20_000_000


@dataclass(frozen=True)
class Options:
    """How runs are made and judged; an unknown name is an error."""

    runs: int = 10
    method: str = "multiplicative"
    seed: int = 2021
    max_iter: int = 2000
    by_w: bool = False
    cutoff: float = 0.5
    accept_ratio: float = 1.0
    accept_factor: float = float("inf")
    best: bool = True
    resample: bool = False
    kernel: dict = field(default_factory=dict)

    def but(self, **kw) -> Options:
        return replace(self, **kw)


def to_matrix(rows: DataFrame, key: str = "id", vec: str = "x", most_cells: int = MOST_CELLS) -> tuple[list, np.ndarray]:
    """(ids in order, array); refuses matrices too large for one task."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("m")).first()
    if size["n"] * (size["m"] or 0) > most_cells:
        raise ValueError(f"{size['n']} x {size['m']} cells: use factorize_tall")
    got = rows.select(key, F.transform(vec, lambda v: v.cast("double")).alias(vec)).orderBy(key).toArrow()
    flat = got.column(vec).combine_chunks().flatten().to_numpy(zero_copy_only=False)  # missing cells as NaN
    return got.column(key).to_pylist(), np.array(flat, float).reshape(got.num_rows, size["m"] or 0)


def wide_to_rows(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]).alias("x"))


def cells_to_rows(cells: DataFrame, columns: int) -> DataFrame:
    """(i, j, v) to (id, x) with absent cells missing."""
    got = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_m"))
    return got.select(F.col("i").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.try_element_at("_m", j.cast(dict(cells.dtypes)["j"]))).alias("x"))


def single_run(x: np.ndarray, k: int, seed: int, o: Options, w=None, h=None) -> tuple[np.ndarray, np.ndarray, float]:
    data = K.bootstrap(x, seed) if o.resample else x
    kw = dict(o.kernel)
    if o.method == "multiplicative":
        w_, h_, _ = K.multiplicative(data, k, seed, w, h, max_iter=o.max_iter, **kw)
    elif o.method == "squares":
        w_, h_, _ = K.squares(data, k, seed, w, h, max_iter=o.max_iter, **kw)
    elif o.method == "sparse":
        w_, h_, _ = K.sparse(data, k, seed, max_iter=o.max_iter, **kw)
    elif o.method == "alternating":
        w_, h_, _ = K.alternating(data, k, seed, w=w, h=h, **kw)
    elif o.method == "mixing":
        w_, h_, _, fit = K.mixing(data, k, seed, **kw)
        return w_, h_, fit
    else:
        raise ValueError(f"no such method: {o.method}")
    if not (kw.get("fix_w") or kw.get("fix_h")):
        w_, h_ = K.normalized(w_, h_, o.by_w)
    return w_, h_, K.residual(x, w_, h_)


RUN = "k int, run int, fit double, w array<array<double>>, h array<array<double>>"


def ensemble(rows: DataFrame, ks: list[int], o: Options = Options(), h_fixed: np.ndarray | None = None, x: np.ndarray | None = None) -> DataFrame:
    """(k, run, fit, w, h): every run of every k, each in a task of its own. x: the rows' matrix, if it's there already."""
    spark = rows.sparkSession
    x = to_matrix(rows)[1] if x is None else x
    shared = spark.sparkContext.broadcast((x, h_fixed))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, h = shared.value
        out = []
        for k, r in zip(pdf["k"], pdf["run"]):
            p = o if h is None else o.but(kernel=o.kernel | {"fix_h": True})
            w, hh, fit = single_run(x, int(k), o.seed + int(r), p, h=h)
            out.append((int(k), int(r), fit, w.tolist(), hh.tolist()))
        return pd.DataFrame(out, columns=["k", "run", "fit", "w", "h"])

    todo = spark.range(len(ks) * o.runs).select(F.element_at(F.array(*[F.lit(k) for k in ks]), (F.floor(F.col("id") / o.runs) + 1).cast("int")).alias("k"), (F.col("id") % o.runs + 1).cast("int").alias("run"))
    return todo.groupBy("k", "run").applyInPandas(run, RUN)


SOLUTION = "k int, fit double, robustness double, aic double, w array<array<double>>, h array<array<double>>, silhouettes array<double>, kept int"


def solutions(runs: DataFrame, rows: DataFrame, o: Options = Options(), x: np.ndarray | None = None) -> DataFrame:
    """One row a k: the best run's factors (or the clusters' means), the worst cluster's silhouette, AIC.

    Runs with a fit that isn't a number, beyond accept_factor times the best, or beyond the best accept_ratio of all
    are left out. The rows of one k are its runs, a bounded number.
    """
    x = to_matrix(rows)[1] if x is None else x
    observed = int((~np.isnan(x)).sum())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        pdf = pdf[np.isfinite(pdf["fit"])].sort_values(["fit", "run"])
        pdf = pdf[pdf["fit"] <= max(pdf["fit"].iloc[0], 1e-300) * o.accept_factor].head(max(1, int(np.ceil(o.accept_ratio * len(pdf)))))
        ws, hs = [np.array([list(r) for r in w], float) for w in pdf["w"]], [np.array([list(r) for r in h], float) for h in pdf["h"]]
        factors = [w.T for w in ws] if o.by_w else hs
        labels = K.matched(factors)
        s = K.silhouettes(factors, labels)
        w, h, fit = ws[0], hs[0], float(pdf["fit"].iloc[0])
        if not o.best:
            w = np.mean([a[:, np.argsort(c)] for a, c in zip(ws, labels)], axis=0)
            h = np.mean([a[np.argsort(c)] for a, c in zip(hs, labels)], axis=0)
            fit = K.residual(x, w, h)
        order = np.argsort(-(w.sum(axis=0) * h.sum(axis=1)), kind="stable")
        w, h, s = w[:, order], h[order], s[order]
        p = w.size + h.size - (len(w) if o.method == "mixing" else 0)
        return pd.DataFrame([(k, fit, float(s.min()), K.criterion(fit, observed, p), w.tolist(), h.tolist(), s.tolist(), len(pdf))], columns=["k", "fit", "robustness", "aic", "w", "h", "silhouettes", "kept"])

    return runs.groupBy("k").applyInPandas(one, SOLUTION)


def sweep(rows: DataFrame, ks: list[int], o: Options = Options()) -> DataFrame:
    _, x = to_matrix(rows)
    return solutions(ensemble(rows, ks, o, x=x), rows, o, x)


def chosen_k(found: DataFrame, cutoff: float = 0.5, strict: bool = True) -> int | None:
    """The last k with a robustness over the cutoff; otherwise none or, if not strict, the most robust."""
    got = found.select("k", "robustness").collect()
    good = [r["k"] for r in got if r["robustness"] > cutoff]
    if good:
        return max(good)
    return None if strict or not got else max(got, key=lambda r: (r["robustness"], -r["k"]))["k"]


def chosen_ks(found: DataFrame, cutoff: float = 0.5, also: list[int] | None = None, strict: bool = True) -> list[int]:
    got = found.select("k", "robustness").collect()
    good = {r["k"] for r in got if r["robustness"] > cutoff} | set(also or [])
    if not good and not strict and got:
        good = {max(got, key=lambda r: (r["robustness"], -r["k"]))["k"]}
    return sorted(good)


def ks_by_factor(found: DataFrame, places: list[int], cutoff: float = 0.5, by_w: bool = False, also: list[int] | None = None, robustness: float = 0.5, strict: bool = True) -> list[int]:
    """The acceptable ks and those in which a signal's share (of its own largest) at one of the places is over the cutoff:
    places of columns of H, or with by_w of rows of W. Of a single k only its robustness counts."""
    ks = chosen_ks(found, robustness, also, strict)
    rows = found.select("k", "w" if by_w else "h").collect()
    if len(rows) > 1:
        for r in rows:
            f = np.array(r[1], float).T if by_w else np.array(r[1], float)
            share = f / np.maximum(f.max(axis=1, keepdims=True), 1e-300)
            if (share[:, places] > cutoff).any():
                ks.append(r["k"])
    return sorted(set(ks))


def with_choice(found: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(k, fit, robustness, aic, chosen)."""
    last = found.agg(F.max(F.when(F.col("robustness") > cutoff, F.col("k"))).alias("_k"))
    return found.crossJoin(F.broadcast(last)).select("k", "fit", "robustness", "aic", F.coalesce(F.col("k") == F.col("_k"), F.lit(False)).alias("chosen"))


def rescaled(w: np.ndarray, h: np.ndarray, by_w: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same product with the largest value of each column of W (or row of H) 1."""
    s = w.max(axis=0) if by_w else h.max(axis=1)
    s = np.where(s > 0, s, 1)
    return (w / s, h * s[:, None]) if by_w else (w * s, h / s[:, None])


def factor_cells(found: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """W as (i, k, w) and H as (k, j, h) of one solution."""
    one = found.where(F.col("k") == k)
    w = one.select(F.posexplode("w").alias("i", "_r")).select("i", F.posexplode("_r").alias("k", "w"))
    h = one.select(F.posexplode("h").alias("k", "_r")).select("k", F.posexplode("_r").alias("j", "h"))
    return w, h


def fold_in(rows: DataFrame, h: np.ndarray, ridge: float = 0.0, key: str = "id", vec: str = "x") -> DataFrame:
    """(key, w): nonnegative weights of each row for a fixed H (k x m); row by row, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(h, float))
    kind = dict(rows.dtypes)[key]

    def run(batches):
        a = shared.value.T
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column(1).to_pylist()], float).reshape(batch.num_rows, len(a))
            w = K.nonnegative_solve(a, x.T, ridge=ridge).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.tolist(), pa.list_(pa.float64()))], [key, "w"])

    return rows.select(key, vec).mapInArrow(run, f"{key} {kind}, w array<double>")


def fold_error(rows: DataFrame, h: np.ndarray, vec: str = "x") -> float:
    """The Frobenius norm of what fold_in leaves; each batch gives one sum."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(h, float))

    def run(batches):
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column(0).to_pylist()], float).reshape(batch.num_rows, shared.value.shape[1])
            w = K.nonnegative_solve(shared.value.T, x.T).T
            yield pa.RecordBatch.from_arrays([pa.array([K.residual(x, w, shared.value) ** 2])], ["e"])

    return float(rows.select(vec).mapInArrow(run, "e double").agg(F.coalesce(F.sum("e"), F.lit(0.0))).first()[0] ** 0.5)


def mapping(x: np.ndarray, y: np.ndarray, a: DataFrame, ridge: float = 1e-8) -> tuple[np.ndarray, DataFrame]:
    """Learn Y = X H with H >= 0, then predict rows (id, x) of a: (H, (id, y))."""
    h = K.nonnegative_solve(np.array(x, float), np.array(y, float), ridge=ridge)
    cols = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in h[:, j]]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) for j in range(h.shape[1])]
    return h, a.select("id", F.array(*cols).alias("y"))


def flips(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bool]:
    """Per column of x, whether turning its range around brings a's predictions nearer to b."""
    def error(xx, aa):
        return float(np.linalg.norm(b - aa @ K.nonnegative_solve(xx, y, ridge=1e-8)))

    base, out = error(x, a), []
    for j in range(x.shape[1]):
        top = np.nanmax(np.concatenate([x[:, j], a[:, j]])) + np.nanmin(np.concatenate([x[:, j], a[:, j]]))
        xx, aa = x.copy(), a.copy()
        xx[:, j], aa[:, j] = top - xx[:, j], top - aa[:, j]
        out.append(error(xx, aa) < base)
    return out


def ridge_regression(rows: DataFrame, predict: DataFrame, inputs: list[str], target: str, ridge: float = 0.1) -> DataFrame:
    """predict's columns and estimate: least squares with ridge times the squared weights, the bias free. One aggregate gives
    the moments of the rows without missing values, whatever their number; the equations have a row an input."""
    xs, y = [m.value(c) for c in inputs], m.value(target)
    whole = y.isNotNull()
    for x in xs:
        whole = whole & x.isNotNull()
    cols = [*xs, y]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    got = rows.where(whole).agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
    n, means = got[0], np.array([0.0 if v is None else v for v in got[1 : 1 + len(cols)]])
    spread = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, got[1 + len(cols) :]):
        spread[i, j] = spread[j, i] = (v or 0.0) * n
    weights = np.linalg.lstsq(spread[:-1, :-1] + ridge * np.eye(len(inputs)), spread[:-1, -1], rcond=None)[0]
    estimate = F.lit(float(means[-1]))
    for x, w, mean in zip(xs, weights, means):
        estimate = estimate + (x - float(mean)) * float(w)
    return predict.withColumn("estimate", estimate)


def progressive(rows: DataFrame, windows: list[int], ks: list[int], o: Options = Options()) -> DataFrame:
    """(window, k, fit_window, fit_all): factors learned on the first rows of each window, then all rows with that H fixed."""
    out, spark = [], rows.sparkSession
    for size in windows:
        some = rows.orderBy("id").limit(size)
        found = materialized(sweep(some, ks, o))
        k = chosen_k(found, o.cutoff, strict=False)
        best = found.where(F.col("k") == k).first()
        h = np.array(best["h"])
        out.append((size, k, float(best["fit"]), fold_error(rows, h)))
    return spark.createDataFrame(out, "window int, k int, fit_window double, fit_all double")


def forecast(df: DataFrame, id_col: str, month_col: str, value: str, train_end: str, ks: list[int], o: Options = Options()) -> DataFrame:
    """(id, place, v, estimate, known): each id's months, counted from its first positive one, as mixtures of signals.

    The signals are learned on what was known at train_end (a date): rows are places, columns ids. With them fixed, the
    ids known at a place give its weights, and these all ids' values there. known: the month was part of the training.
    """
    from .pivot import shifted_matrix

    spark = df.sparkSession
    past = df.where(F.col(month_col).cast("date") <= F.to_date(F.lit(train_end)))
    train = shifted_matrix(past, id_col, month_col, value)
    ids = [r[0] for r in train.select("id").distinct().orderBy("id").limit(100_001).collect()]
    if len(ids) > 100_000:
        raise ValueError("more than 100000 ids: the signals have a column an id")
    places = spark.createDataFrame([(v, j) for j, v in enumerate(ids)], f"id {dict(train.dtypes)['id']}, j int")
    cells = train.join(places, "id").select(F.col("place").alias("i"), "j", "v")
    rows = cells_to_rows(cells, len(ids))
    k = chosen_k(found := sweep(rows, ks, o), o.cutoff, strict=False)
    h = np.array(found.where(F.col("k") == k).first()["h"], float)
    weights = fold_in(rows, h).withColumnRenamed("id", "place")
    share = spark.createDataFrame([(v, h[:, j].tolist()) for j, v in enumerate(ids)], f"id {dict(train.dtypes)['id']}, h array<double>")
    whole = shifted_matrix(df.join(places, F.col(id_col) == F.col("id"), "left_semi"), id_col, month_col, value)
    estimate = F.aggregate(F.zip_with("w", "h", lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x)
    out = whole.join(weights, "place").join(share, "id").join(train.select("id", "place", F.lit(True).alias("_t")), ["id", "place"], "left")
    return out.select("id", "place", "v", estimate.alias("estimate"), F.coalesce("_t", F.lit(False)).alias("known"))


def uncertainty(rows: DataFrame, k: int, reruns: int, o: Options = Options()) -> DataFrame:
    """(i, j, least, largest, variance) of the reconstruction over resampled reruns."""
    from .reduce import ensemble_ranges

    runs = ensemble(rows, [k], o.but(runs=reruns, resample=True))
    w = runs.select("run", F.posexplode("w").alias("i", "_w"))
    h = runs.select("run", F.col("h"))
    m = w.join(h, "run").select("run", "i", "_w", F.posexplode(F.arrays_zip(*[F.col("h")[q].alias(f"c{q}") for q in range(k)])).alias("j", "_c"))
    v = sum((F.col("_w")[q] * F.col("_c")[f"c{q}"] for q in range(k)), F.lit(0.0))
    return ensemble_ranges(m.select("run", "i", "j", v.alias("v")))


def tensor_sweep(cells: DataFrame, axes: list[str], ks: list[int], o: Options = Options(), along: list[str] | None = None) -> DataFrame:
    """(axis, k, fit, robustness, aic): the array with these axes, unfolded along each of them (or those in along), factorized."""
    from .transform import unfold

    parts = []
    for a in along or axes:
        flat = unfold(cells, axes, a).select(F.col("row").alias("i"), F.col("col").alias("j"), "v")
        n = flat.agg(F.max("j")).first()[0] + 1
        parts.append(sweep(cells_to_rows(flat, n), ks, o).select(F.lit(a).alias("axis"), "k", "fit", "robustness", "aic"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def factorize_tall(rows: DataFrame, k: int, iterations: int = 50, seed: int = 0, tol: float = 1e-6, save_every: int = 2) -> tuple[DataFrame, np.ndarray, float]:
    """((id, w), H, fit) for any number of rows; columns are few. One pass an iteration; zeros and gaps as in the kernel."""
    spark = rows.sparkSession
    m = rows.select(F.size("x")).first()[0]
    kind = dict(rows.dtypes)["id"]
    h = np.random.default_rng(seed).random((k, m))
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda q: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", q), 11).cast("double") + 0.5) / float(2**53))
    state = rows.select("id", "x", start.alias("w"))

    def step(shared, with_w):
        def run(batches):
            hh = shared.value
            num, wsum, sse = np.zeros_like(hh), np.zeros(len(hh)), 0.0
            for batch in batches:
                raw = np.array([[np.nan if v is None else v for v in r] for r in batch.column(1).to_pylist()], float).reshape(batch.num_rows, hh.shape[1])
                w = np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, len(hh))
                gap = np.isnan(raw)
                x = np.where(gap, w @ hh, np.where(raw == 0, 1e-32, raw))
                if with_w:
                    w = w * ((x / np.maximum(w @ hh, 1e-300)) @ hh.T) / np.maximum(hh.sum(axis=1), 1e-300)
                    x = np.where(gap, w @ hh, x)
                if with_w == "rows":
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w.tolist(), pa.list_(pa.float64()))], ["id", "x", "w"])
                    continue
                v = w @ hh
                num += w.T @ (x / np.maximum(v, 1e-300))
                wsum += w.sum(axis=0)
                sse += float(np.nansum((raw - v) ** 2))
            if with_w != "rows":
                flat = np.concatenate([num.ravel(), wsum, [sse]])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["p", "v"])

        return run

    def totals():
        got = np.zeros(k * m + k + 1)
        for r in state.mapInArrow(step(spark.sparkContext.broadcast(h), False), "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect():
            got[r["p"]] = r["v"]
        return got[: k * m].reshape(k, m), got[k * m : -1], got[-1]

    fit = np.inf
    for i in range(iterations):
        num, wsum, sse = totals()
        now = float(np.sqrt(sse))
        if abs(fit - now) <= tol * max(now, 1e-12):
            break
        fit = now
        h = h * num / np.maximum(wsum, 1e-300)[:, None]
        state = state.mapInArrow(step(spark.sparkContext.broadcast(h), "rows"), f"id {kind}, x array<double>, w array<double>")
        if i % save_every == save_every - 1:  # each pass goes through the updates since then
            state = materialized(state)
    return state.select("id", "w"), h, fit


def selection_table(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(k, r2, fit, robustness): r2 of data cells (i, j, v) with each k's reconstruction, fit over its largest, robustness."""
    w = found.select("k", F.posexplode("w").alias("i", "_w"), "h")
    e = w.select("k", "i", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(F.element_at("h", 1)) - 1), lambda j: F.aggregate(F.zip_with("_w", F.transform("h", lambda r: F.element_at(r, j + 1)), lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b))).alias("j", "e"))
    r2 = e.join(cells, ["i", "j"]).groupBy("k").agg(m.r2("v", "e").alias("r2"))
    top = found.agg(F.max("fit").alias("_t"))
    return found.crossJoin(F.broadcast(top)).join(r2, "k").select("k", "r2", F.try_divide("fit", "_t").alias("fit"), "robustness")


def sweep_cached(rows: DataFrame, ks: list[int], root: str, case: str = "sweep", o: Options = Options()) -> DataFrame:
    """Solutions kept under the case, the data's content key and the options; only the ks that aren't there are computed."""
    import hashlib

    from ..sources.store import content_key, load_solutions

    name = f"{case}-{content_key(rows)[:16]}-{hashlib.sha256(repr(o).encode()).hexdigest()[:16]}"
    have = {r["k"] for r in load_solutions(rows.sparkSession, root, name).select("k").collect()}
    todo = [k for k in ks if k not in have]
    if todo:
        sweep(rows, todo, o).withColumn("case", F.lit(name)).write.partitionBy("case", "k").mode("append").parquet(root)
    return load_solutions(rows.sparkSession, root, name, ks)
