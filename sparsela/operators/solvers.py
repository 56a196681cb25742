"""Sparse inference on NumPy batches: signals are rows, the dictionary has one atom a row.

Every rule (step, stop, restart, line search) looks at one signal only, so a signal's code does
not depend on the batch in which it is solved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.penalties import L1, Cauchy, Penalty


@dataclass
class Codes:
    a: np.ndarray
    iterations: np.ndarray
    converged: np.ndarray
    objective: np.ndarray
    reason: np.ndarray


def lipschitz(d: np.ndarray) -> float:
    """Largest eigenvalue of the Gram matrix."""
    return max(float(np.linalg.eigvalsh(d @ d.T)[-1]), 1e-12)


def power_iteration(d: np.ndarray, steps: int = 50, tol: float = 1e-7) -> float:
    """The same by power iteration from a fixed start; stops on small relative change."""
    g = d @ d.T
    v, last = np.ones(len(g)) / np.sqrt(len(g)), 0.0
    for _ in range(steps):
        w = g @ v
        n = float(np.linalg.norm(w))
        if n < 1e-12:
            return 1e-12
        v = w / n
        if abs(n - last) <= tol * n:
            break
        last = n
    return max(n, 1e-12)


def objective(x, d, pen: Penalty, a) -> np.ndarray:
    r = x - a @ d
    return 0.5 * (r * r).sum(1) + pen.np_value(a)


def _result(x, d, pen, a, it, done, reason="iterate") -> Codes:
    why = np.where(done, reason, "max_iter").astype(object)
    return Codes(a, it, done, objective(x, d, pen, a), why)


def proximal_gradient(x, d, pen: Penalty, max_iter: int = 200, tol: float = 1e-6, accelerated: bool = True, step: str | float = "fixed", restart: str = "none", monotone: bool = False, start=None, **_) -> Codes:
    """ISTA and FISTA.

    step: ``fixed`` (1 / L), ``backtracking``, ``diminishing`` (0.99^k / L) or a number. restart:
    ``none``, ``function`` (objective rises), ``gradient`` (step against the momentum) or
    ``periodic`` (every 50). monotone keeps the better of two iterates. Stops on
    ``|change| <= tol max(1, |a|)``; with tol 0 all iterations are made.
    """
    n, k = len(x), len(d)
    g, c, big = d @ d.T, x @ d.T, lipschitz(d)
    a = np.zeros((n, k)) if start is None else start.copy()
    y, t = a.copy(), np.ones(n)
    it, done = np.zeros(n, np.int64), np.zeros(n, bool)
    lips = np.full(n, big if not isinstance(step, float) else 1 / step)
    if step == "backtracking":
        lips[:] = big / 8
    best = objective(x, d, pen, a) if monotone or restart == "function" else None
    for i in range(max_iter):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        yl, cl = y[live], c[live]
        gl = yl @ g - cl
        if step == "backtracking":
            while True:
                s = 1 / lips[live, None]
                z = pen.np_prox(yl - s * gl, s)
                diff = z - yl
                # the quadratic upper bound of the smooth part must hold
                bad = ((diff @ g) * diff).sum(1) > lips[live] * (diff * diff).sum(1) * (1 + 1e-12)
                if not bad.any():
                    break
                lips[live[bad]] *= 2
        else:
            s = 1 / lips[live, None] * (0.99**i if step == "diminishing" else 1.0)
            z = pen.np_prox(yl - s * gl, s)
        old = a[live]
        if best is not None:
            f = objective(x[live], d, pen, z)
            rise = f > best[live]
            if monotone:
                z = np.where(rise[:, None], old, z)
            best[live] = np.where(rise & monotone, best[live], f)
        change = z - old
        if accelerated:
            t1 = (1 + np.sqrt(1 + 4 * t[live] ** 2)) / 2
            beta = (t[live] - 1) / t1
            if restart == "function":
                beta, t1 = np.where(rise, 0.0, beta), np.where(rise, 1.0, t1)
            elif restart == "gradient":
                against = ((yl - z) * change).sum(1) > 0
                beta, t1 = np.where(against, 0.0, beta), np.where(against, 1.0, t1)
            elif restart == "periodic" and (i + 1) % 50 == 0:
                beta, t1 = np.zeros_like(beta), np.ones_like(t1)
            y[live], t[live] = z + beta[:, None] * change, t1
        else:
            y[live] = z
        a[live] = z
        it[live] = i + 1
        stop = np.sqrt((change * change).sum(1)) <= tol * np.maximum(1, np.sqrt((z * z).sum(1))) if tol else np.zeros(len(live), bool)
        if monotone:
            stop &= ~rise | (t[live] == 1)
            t[live] = np.where(rise, 1.0, t[live])
            y[live] = np.where(rise[:, None], z, y[live])
        done[live] = stop
    return _result(x, d, pen, a, it, done)


def ista(x, d, pen, **kw) -> Codes:
    return proximal_gradient(x, d, pen, accelerated=False, **kw)


def fista(x, d, pen, **kw) -> Codes:
    return proximal_gradient(x, d, pen, **kw)


def coordinate_descent(x, d, pen: Penalty, max_iter: int = 200, tol: float = 1e-6, start=None, **_) -> Codes:
    """Cyclic descent; atoms need not have unit norm (the prox gets the step 1 / |d|^2)."""
    n, k = len(x), len(d)
    g, c = d @ d.T, x @ d.T
    a = np.zeros((n, k)) if start is None else start.copy()
    it, done = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(max_iter):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        al, old = a[live], a[live].copy()
        for j in range(k):
            h = max(g[j, j], 1e-12)
            al[:, j] = pen.np_prox((al[:, j] + (c[live, j] - al @ g[:, j]) / h)[:, None], 1 / h)[:, 0]
        a[live] = al
        it[live] = i + 1
        change = np.sqrt(((al - old) ** 2).sum(1))
        done[live] = change <= tol * np.maximum(1, np.sqrt((al * al).sum(1))) if tol else False
    return _result(x, d, pen, a, it, done)


def _refit(g, c, support):
    s = np.array(support)
    return np.linalg.lstsq(g[np.ix_(s, s)], c[s], rcond=None)[0]


def _one_by_one(g, c, norms, m: int, tol: float, weak: float | None):
    """Pursuits that take an atom a step: all signals take the step together, and the equations of
    their supports, which have one size, are solved as a stack."""
    n, k = c.shape
    a, it, done = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros(n, bool)
    live, support = np.arange(n), np.empty((n, 0), np.int64)
    for _ in range(m):
        corr = np.abs(c[live] - a[live] @ g) / norms
        np.put_along_axis(corr, support, -1, axis=1)
        top = corr.max(1)
        stay = top > tol
        done[live[~stay]] = True
        live, support, corr, top = live[stay], support[stay], corr[stay], top[stay]
        if not len(live):
            break
        new = corr.argmax(1) if weak is None else (corr >= weak * top[:, None]).argmax(1)
        support = np.hstack((support, new[:, None]))
        lhs, rhs = g[support[:, :, None], support[:, None, :]], np.take_along_axis(c[live], support, 1)
        try:
            coef = np.linalg.solve(lhs, rhs[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            coef = np.full_like(rhs, np.inf)
        bad = ~np.isfinite(coef).all(1) | (np.abs(coef).max(1) > 1e8 * (1 + np.abs(rhs).max(1)))
        if bad.any():  # atoms that depend on each other
            coef[bad] = (np.linalg.pinv(lhs[bad], hermitian=True) @ rhs[bad][:, :, None])[:, :, 0]
        a[live[:, None], support] = coef
        it[live] += 1
    done[live] = True
    return a, it, done


def omp(x, d, pen: Penalty | None = None, n_atoms: int | None = None, tol: float = 1e-10, variant: str = "standard", weak: float = 0.5, **_) -> Codes:
    """Orthogonal matching pursuit. Of equal correlations the lowest atom is taken.

    variant: ``standard``; ``weak`` (lowest atom with at least ``weak`` of the best correlation);
    ``stagewise`` (all such atoms at once); ``regularized`` (of the best n_atoms, the run with
    correlations within a factor 2 that has the largest energy). Default of n_atoms:
    max(1, min(K // 4, 50)).
    """
    k = len(d)
    m = min(n_atoms or max(1, min(k // 4, 50)), k)
    norms = np.maximum(np.sqrt((d * d).sum(1)), 1e-12)
    g, c = d @ d.T, x @ d.T
    if variant in ("standard", "weak"):
        a, it, done = _one_by_one(g, c, norms, m, tol, weak if variant == "weak" else None)
        return _result(x, d, pen or L1(0.0), a, it, done, "support")
    a, it, done = np.zeros((len(x), k)), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    for i in range(len(x)):
        support: list[int] = []
        coef = np.zeros(0)
        while len(support) < m:
            corr = np.abs(c[i] - (g[:, support] @ coef if support else 0)) / norms
            corr[support] = -1
            top = corr.max()
            if top <= tol:
                done[i] = True
                break
            if variant == "stagewise":
                new = np.flatnonzero(corr >= weak * top).tolist()
            elif variant == "regularized":
                rank = np.argsort(-corr, kind="stable")[: m - len(support)]
                rank = rank[corr[rank] > tol]
                runs = [rank[(corr[rank] <= corr[r]) & (corr[rank] >= corr[r] / 2)] for r in rank]
                new = max(runs, key=lambda r: (corr[r] ** 2).sum()).tolist()
            else:
                raise ValueError(f"unknown variant {variant!r}")
            support += new[: m - len(support)]
            coef = _refit(g, c[i], support)
            it[i] += 1
        a[i, support] = coef
        done[i] |= len(support) >= m
    return _result(x, d, pen or L1(0.0), a, it, done, "support")


def conjugate_gradient(x, d, pen: Penalty, max_iter: int = 100, tol: float = 1e-6, beta: str = "pr+", armijo: float = 1e-4, clip: float = 1e3, **_) -> Codes:
    """Nonlinear conjugate gradient with Armijo halving, for penalties with a gradient.

    beta: ``pr+``, ``fr``, ``dy``, ``hs`` or ``steepest``. Stops on a small gradient
    (``gradient``), a small change (``parameter_change``) or no descent step (``line_search``).
    """
    if not pen.differentiable:
        raise ValueError("conjugate gradient needs a penalty with a gradient")
    n, k = len(x), len(d)
    g, c = d @ d.T, x @ d.T
    grad_of = lambda a, rows: a @ g - c[rows] + pen.np_grad(a)
    every = np.arange(n)
    a = np.zeros((n, k))
    grad = grad_of(a, every)
    p = -grad
    f = objective(x, d, pen, a)
    it, reason = np.zeros(n, np.int64), np.full(n, "max_iter", object)
    live = every
    for i in range(max_iter):
        small = np.sqrt((grad[live] ** 2).sum(1)) <= tol
        reason[live[small]] = "gradient"
        live = live[~small]
        if not len(live):
            break
        slope = (grad[live] * p[live]).sum(1)
        wrong = slope >= 0
        p[live[wrong]] = -grad[live[wrong]]
        slope[wrong] = -(grad[live[wrong]] ** 2).sum(1)
        size = np.sqrt((p[live] ** 2).sum(1))
        step = np.minimum(1.0, clip / np.maximum(size, 1e-300))
        open_ = np.ones(len(live), bool)
        trial, ft = a[live].copy(), f[live].copy()
        for _ in range(40):
            rows = live[open_]
            t = a[rows] + step[open_, None] * p[rows]
            v = objective(x[rows], d, pen, t)
            ok = v <= f[rows] + armijo * step[open_] * slope[open_]
            where = np.flatnonzero(open_)
            trial[where[ok]], ft[where[ok]] = t[ok], v[ok]
            open_[where[ok]] = False
            step[open_] /= 2
            if not open_.any():
                break
        it[live] = i + 1
        new = grad_of(trial, live)
        old = grad[live]
        y = new - old
        if beta == "fr":
            b = (new * new).sum(1) / np.maximum((old * old).sum(1), 1e-300)
        elif beta == "dy":
            b = (new * new).sum(1) / np.where(np.abs(q := (p[live] * y).sum(1)) < 1e-300, 1e-300, q)
        elif beta == "hs":
            b = (new * y).sum(1) / np.where(np.abs(q := (p[live] * y).sum(1)) < 1e-300, 1e-300, q)
        elif beta == "steepest":
            b = np.zeros(len(live))
        else:
            b = np.maximum(0, (new * y).sum(1) / np.maximum((old * old).sum(1), 1e-300))
        moved = np.sqrt(((trial - a[live]) ** 2).sum(1))
        tiny = moved <= tol * 1e-3 * np.maximum(1, np.sqrt((trial**2).sum(1)))
        a[live], f[live], grad[live] = trial, ft, new
        p[live] = -new + b[:, None] * p[live]
        reason[live[tiny]] = np.where(open_[tiny], "line_search", "parameter_change")
        live = live[~tiny]
    done = reason != "max_iter"
    return Codes(a, it, done, f, reason)


def gradient_descent(x, d, pen: Penalty, max_iter: int = 200, tol: float = 1e-6, rate: float = 0.05, **_) -> Codes:
    """Plain descent with an adaptive rate: x0.8 after a rise, x1.05 after a fall of over 5 %, in
    [0.001, 0.2]."""
    g, c = d @ d.T, x @ d.T
    n = len(x)
    a, lr = np.zeros((n, len(d))), np.full(n, rate)
    f = objective(x, d, pen, a)
    it, done = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(max_iter):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        step = lr[live, None] * (a[live] @ g - c[live] + pen.np_grad(a[live]))
        a[live] -= step
        new = objective(x[live], d, pen, a[live])
        rate_ = np.where(new > f[live], lr[live] * 0.8, np.where(new < 0.95 * f[live], lr[live] * 1.05, lr[live]))
        lr[live], f[live], it[live] = np.clip(rate_, 0.001, 0.2), new, i + 1
        done[live] = np.sqrt((step * step).sum(1)) <= tol * np.maximum(1, np.sqrt((a[live] ** 2).sum(1))) if tol else False
    return _result(x, d, pen, a, it, done)


def log_prior(x, d, pen: Penalty | None = None, lam: float = 0.1, sigma: float = 1.0, **kw) -> Codes:
    """Conjugate gradient on the log prior (Cauchy penalty)."""
    return conjugate_gradient(x, d, Cauchy(lam, sigma), **kw)


SOLVERS = {"fista": fista, "ista": ista, "coordinate_descent": coordinate_descent, "omp": omp, "ncg": conjugate_gradient, "gradient": gradient_descent, "log_prior": log_prior}


def get_solver(name: str):
    if name not in SOLVERS:
        raise ValueError(f"unknown solver {name!r}; there are {', '.join(sorted(SOLVERS))}")
    return SOLVERS[name]


def register_solver(name: str, solver) -> None:
    SOLVERS[name] = solver


def auto_solver(pen: Penalty) -> str:
    """fista for penalties with a cheap prox, ncg for the others that have a gradient."""
    if pen.prox_friendly:
        return "fista"
    if pen.differentiable:
        return "ncg"
    raise ValueError(f"no solver for {type(pen).__name__}: neither prox nor gradient")
