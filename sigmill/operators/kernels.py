"""Factorization kernels on one task's arrays (numpy only); no Spark here."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def prepared(x: np.ndarray, least: float = 1e-32) -> tuple[np.ndarray, np.ndarray]:
    """(x with missing and zero cells at least, mask of missing cells); negative values are an error."""
    x = np.array(x, float)
    gap = np.isnan(x)
    if (x[~gap] < 0).any():
        raise ValueError("values must not be negative")
    x[gap | (x == 0)] = least
    return x, gap


def residual(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> float:
    """Frobenius norm over observed cells."""
    d = x - w @ h
    return float(np.sqrt(np.nansum(d * d)))


def multiplicative(x, k, seed=0, w=None, h=None, fix_w=False, fix_h=False, max_iter=2000, tol=1e-19, small=1e-3, bad_limit=10, attempts=2, steady=1000, weight=1.0):
    """Divergence updates, H before W; missing cells are refilled from the current product in each iteration.

    Every tenth iteration the weighted squared error decides: under tol stops; ten checks in a row without a gain of
    ``small`` (relative to nothing) use one of ``attempts``; an unchanged assignment of columns to signals over
    ``steady`` checks stops too.
    """
    raw = np.array(x, float)
    x, gap = prepared(raw)
    rng = np.random.default_rng(seed)
    n, m = x.shape
    w = rng.random((n, k)) if w is None else np.array(w, float)
    h = rng.random((k, m)) if h is None else np.array(h, float)
    best, bad, tries, same, link = np.inf, 0, 0, 0, None
    if gap.any():
        x[gap] = (w @ h)[gap]
    for i in range(1, max_iter + 1):
        if not fix_h:
            h *= (w.T @ (x / np.maximum(w @ h, 1e-300))) / np.maximum(w.sum(axis=0), 1e-300)[:, None]
        if not fix_w:
            w *= ((x / np.maximum(w @ h, 1e-300)) @ h.T) / np.maximum(h.sum(axis=1), 1e-300)[None, :]
        if gap.any():
            x[gap] = (w @ h)[gap]
        if i % 10 == 0:
            d = (raw - w @ h) * weight
            now = float(np.nansum(d * d))
            if now < tol:
                break
            bad = bad + 1 if best - now < small else 0
            best = min(best, now)
            if bad >= bad_limit:
                tries, bad = tries + 1, 0
                if tries > attempts:
                    break
            w, h = np.maximum(w, EPS) if not fix_w else w, np.maximum(h, EPS) if not fix_h else h
            now_link = h.argmin(axis=0)
            same = same + 1 if link is not None and (now_link == link).all() else 0
            link = now_link
            if same > steady:
                break
    return w, h, residual(raw, w, h)


def squares(x, k, seed=0, w=None, h=None, fix_w=False, fix_h=False, max_iter=2000, tol=1e-19, small=1e-12):
    """Multiplicative updates for the squared error; missing cells are refilled from the current product. Stops where ten
    iterations gain less than ``small`` of the error."""
    raw = np.array(x, float)
    x, gap = prepared(raw)
    rng = np.random.default_rng(seed)
    w = rng.random((x.shape[0], k)) if w is None else np.array(w, float)
    h = rng.random((k, x.shape[1])) if h is None else np.array(h, float)
    last = np.inf
    for i in range(1, max_iter + 1):
        if gap.any():
            x[gap] = (w @ h)[gap]
        if not fix_h:
            h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-300)
        if not fix_w:
            w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-300)
        if i % 10 == 0:
            now = residual(raw, w, h) ** 2
            if now < tol or last - now < small * now:
                break
            last = now
    return w, h, residual(raw, w, h)


def sparse(x, k, seed=0, divergence="ed", sparsity=1.0, max_iter=1000, tol=1e-10, w=None, h=None):
    """Beta-divergence updates ('kl', 'ed', 'is') with an L1 weight on H and W's columns of length 1."""
    beta = {"is": 0.0, "kl": 1.0, "ed": 2.0}[divergence] if isinstance(divergence, str) else float(divergence)
    raw = np.array(x, float)
    x, gap = prepared(raw, 1e-9)
    rng = np.random.default_rng(seed)
    w = rng.random((x.shape[0], k)) if w is None else np.array(w, float)
    h = rng.random((k, x.shape[1])) if h is None else np.array(h, float)
    length = np.sqrt((w * w).sum(axis=0))
    w, h = w / length, h * length[:, None]
    last = np.inf
    for _ in range(max_iter):
        v = np.maximum(w @ h, 1e-9)
        if gap.any():
            x[gap] = v[gap]
        h *= (w.T @ (x * v ** (beta - 2))) / np.maximum(w.T @ v ** (beta - 1) + sparsity, 1e-9)
        v = np.maximum(w @ h, 1e-9)
        up, down = (x * v ** (beta - 2)) @ h.T, v ** (beta - 1) @ h.T
        w *= (up + w * (down * w).sum(axis=0)) / np.maximum(down + w * (up * w).sum(axis=0), 1e-9)  # keeps columns' length under the constraint
        w /= np.sqrt((w * w).sum(axis=0))
        v = np.maximum(w @ h, 1e-9)
        if beta == 2:
            cost = ((x - v) ** 2).sum() / 2
        elif beta == 1:
            cost = (x * np.log(x / v) - x + v).sum()
        elif beta == 0:
            cost = (x / v - np.log(x / v) - 1).sum()
        else:
            cost = ((x**beta + (beta - 1) * v**beta - beta * x * v ** (beta - 1)) / (beta * (beta - 1))).sum()
        cost += sparsity * h.sum()
        if abs(last - cost) <= tol * max(abs(cost), 1e-12):
            break
        last = cost
    return w, h, residual(raw, w, h)


def to_simplex(a: np.ndarray) -> np.ndarray:
    """Rows projected onto {v >= 0, sum v = 1}."""
    s = -np.sort(-a, axis=1)
    c = (np.cumsum(s, axis=1) - 1) / np.arange(1, a.shape[1] + 1)
    last = (s > c).sum(axis=1) - 1
    return np.maximum(a - c[np.arange(len(a)), last][:, None], 0)


def nonnegative_solve(a: np.ndarray, b: np.ndarray, iterations: int = 2000, ridge: float = 0.0, top: float | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """H >= 0 (and <= top) that minimizes |W (a H - b)|^2 + ridge |H|^2 over observed cells, by accelerated projected gradient."""
    seen = ~np.isnan(b)
    q = np.where(seen, 1.0 if weights is None else weights**2, 0.0)
    b0 = np.where(seen, b, 0.0)
    step = 1.0 / max(np.linalg.norm(a.T @ a, 2) * q.max(initial=0) + ridge, 1e-30)
    h = np.zeros((a.shape[1], b.shape[1]))
    y, t = h, 1.0
    for _ in range(iterations):
        new = np.maximum(y - step * (a.T @ (q * (a @ y - b0)) + ridge * y), 0)
        if top is not None:
            new = np.minimum(new, top)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - h)
        done = np.abs(new - h).max(initial=0) <= 1e-12 * max(np.abs(new).max(initial=0), 1)
        h, t = new, t2
        if done:
            break
    return h


def alternating(x, k, seed=0, rounds=60, ridge=1e-8, w=None, h=None, fix_w=False, fix_h=False, tolerance=1e-9, top_h=None, inverse_weights=False):
    """Constrained least squares by turns of H and W."""
    x = np.array(x, float)
    rng = np.random.default_rng(seed)
    w = rng.random((x.shape[0], k)) if w is None else np.array(w, float)
    h = rng.random((k, x.shape[1])) if h is None else np.array(h, float)
    q = None
    if inverse_weights:
        q = np.where(x == 0, 0.0, 1.0 / np.where(x == 0, 1, x))
        q = np.where(x == 0, 10 * np.nanmax(q), q)
    last = np.inf
    for _ in range(rounds):
        if not fix_h:
            h = nonnegative_solve(w, x, 300, ridge, top_h, q)
        if not fix_w:
            w = nonnegative_solve(h.T, x.T, 300, ridge, None, None if q is None else q.T).T
        now = residual(x, w, h)
        if last - now < tolerance * max(last, 1e-30) or fix_w or fix_h:
            break
        last = now
    return w, h, residual(x, w, h)


def mixing(x, k, seed=0, iterations=3000, ridge=0.0, deltas=None, delta_columns=None, delta_weight=1.0, ratios=None, ratio_pairs=None, ratio_weight=1.0):
    """Mixing model: rows of W on the simplex, H >= 0; x may have gaps. Times stacked as further rows share H.

    ratios (rows x r) are observed quotients of the columns in ratio_pairs [(a, b), ..]; each adds the term
    ratio_weight * ((WH)_a - ratio * (WH)_b)^2.

    deltas (rows x d) with the columns of H they go with are fitted after the mixing: D is the unbounded least-squares
    solution of sum_k W H D / sum_k W H = delta and doesn't change W or H, so delta_weight has no effect. Returns W, H, D, fit.
    """
    x = np.array(x, float)
    seen = ~np.isnan(x)
    rng = np.random.default_rng(seed)
    w = to_simplex(rng.random((x.shape[0], k)))
    top = np.nanmax(np.where(seen, x, np.nan), axis=0)
    scale = np.where(top > 0, top, 1.0)
    z = np.where(seen, x / scale, 0.0)
    h = rng.random((k, x.shape[1]))
    d, extra = None, 1.0
    if ratios is not None:
        ratios = np.array(ratios, float)
        extra = 1.0 + ratio_weight * (1.0 + np.nanmax(ratios) * (scale[[b for _, b in ratio_pairs]] / scale[[a for a, _ in ratio_pairs]]).max()) ** 2

    def error():
        """The gradient of the squared error by WH, in scaled columns."""
        v = w @ h
        e = seen * (v - z)
        if ratios is not None:
            for q, (a, b) in enumerate(ratio_pairs):
                r = ratios[:, q] * scale[b] / scale[a]
                ok = ~np.isnan(r)
                r = np.where(ok, r, 0.0)
                f = ratio_weight * ok * (v[:, a] - r * v[:, b])
                e[:, a] += f
                e[:, b] -= r * f
        return e

    for _ in range(iterations // 10):
        for _ in range(5):
            h = np.maximum(h - (w.T @ error() + ridge * h) / max(np.linalg.norm(w.T @ w, 2) * extra + ridge, 1e-12), 0)
        for _ in range(5):
            w = to_simplex(w - error() @ h.T / max(np.linalg.norm(h @ h.T, 2) * extra, 1e-12))
    h = h * scale
    if deltas is not None:
        deltas = np.array(deltas, float)
        d = np.zeros((k, deltas.shape[1]))
        for j, c in enumerate(delta_columns):
            a = w * h[:, c][None, :]
            a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
            ok = ~np.isnan(deltas[:, j])
            d[:, j] = np.linalg.lstsq(np.sqrt(delta_weight) * a[ok], np.sqrt(delta_weight) * deltas[ok, j], rcond=None)[0]
    return w, h, d, residual(x, w, h)


def bootstrap(x: np.ndarray, seed: int, scaling: float = 1.0, least: float = EPS**0.5) -> np.ndarray:
    """Each column drawn anew as a multinomial of its own total and shares."""
    rng = np.random.default_rng(seed)
    out = np.array(x, float)
    for j in range(out.shape[1]):
        c = np.nan_to_num(out[:, j] * scaling)
        total = c.sum()
        if total > 0:
            out[:, j] = np.maximum(rng.multinomial(int(round(total)), c / total) / scaling, least)
    return out


def normalized(w: np.ndarray, h: np.ndarray, by_w: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same product with rows of H (or columns of W) summing to 1."""
    s = w.sum(axis=0) if by_w else h.sum(axis=1)
    s = np.where(s == 0, 1, s)
    return (w / s, h * s[:, None]) if by_w else (w * s, h / s[:, None])


def matched(factors: list[np.ndarray]) -> np.ndarray:
    """factors: (k, length) of each run, best run first. (runs, k) labels: the first run's signals are the seeds; each
    later run's are matched one to one, closest cosine first, and added to the seeds' directions."""
    u = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), EPS**2)
    seeds = np.array(factors[0], float)
    k = len(seeds)
    labels = np.zeros((len(factors), k), int)
    labels[0] = np.arange(k)
    for r, f in enumerate(factors[1:], 1):
        d = 1 - u(seeds) @ u(f).T
        free_s, free_f = set(range(k)), set(range(k))
        for at in np.argsort(d, axis=None, kind="stable"):
            s, i = divmod(int(at), k)
            if s in free_s and i in free_f:
                labels[r, i] = s
                free_s.remove(s)
                free_f.remove(i)
        for i in range(k):
            seeds[labels[r, i]] += f[i]
    return labels


def silhouettes(factors: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Mean cosine silhouette of each cluster of signals over the runs."""
    k = labels.shape[1]
    v = np.maximum(np.concatenate(factors), EPS**2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = labels.ravel()
    if k == 1:
        return np.ones(1)
    sums = np.array([u[c == i].sum(axis=0) for i in range(k)])
    n = np.array([(c == i).sum() for i in range(k)])
    d = n[None, :] - u @ sums.T
    own = d[np.arange(len(c)), c] / np.maximum(n[c] - 1, 1)
    d = d / n[None, :]
    d[np.arange(len(c)), c] = np.inf
    other = d.min(axis=1)
    s = np.where(n[c] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return np.array([s[c == i].mean() for i in range(k)])


def criterion(fit: float, observed: int, parameters: int) -> float:
    """2 p + n ln(fit / n), with fit the norm of the residual."""
    return 2 * parameters + observed * float(np.log(max(fit, 1e-300) / observed))


def water_deltas(deltas, k, seed=0, iterations=3000, ridge=1e-6, means=None):
    """(W, D, fit): observed deltas (rows x 2, with gaps) as mixtures of k waters, rows of W on the simplex, D unbounded and
    drawn to means by ridge; alternating projected gradient steps and least squares."""
    y = np.array(deltas, float)
    seen = ~np.isnan(y)
    y = np.where(seen, y, 0.0)
    means = np.zeros((k, y.shape[1])) if means is None else np.array(means, float)
    rng = np.random.default_rng(seed)
    w = to_simplex(rng.random((len(y), k)))
    known = np.flatnonzero(seen.all(axis=1))
    d = y[rng.choice(known, k, replace=len(known) < k)] if len(known) else means.copy()
    for _ in range(iterations):
        step = max(np.linalg.norm(d @ d.T, 2), 1e-12)
        for _ in range(5):
            w = to_simplex(w - (seen * (w @ d - y)) @ d.T / step)
        for j in range(y.shape[1]):
            a = w[seen[:, j]]
            d[:, j] = np.linalg.solve(a.T @ a + ridge / k * np.eye(k), a.T @ y[seen[:, j], j] + ridge / k * means[:, j])
    return w, d, float((seen * (w @ d - y) ** 2).sum())
