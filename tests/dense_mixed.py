"""Linear mixed models with a structured covariance, in dense algebra: two-fold, spatial and spatio-temporal area models.

A structure gives, for variance parameters t, the covariance G of all cells' effects (sampled or not) and its derivatives. Everything else is
the same for all models: V = G[s, s] + diag(psi), Fisher scoring, best predictors of all cells, and their mean squared errors
g1 + g2 + 2 g3, minus the curvature term where the structure isn't linear in t.
Small tables only (DENSE_MOST cells); pure functions, callable on the driver or in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

DENSE_MOST = 3000


@dataclass(frozen=True)
class Structure:
    """cov(t) -> G; slopes(t) -> dG/dt_j; curves(t) -> {(j, k): d2G}, empty if linear; bounds of t by parameter."""

    cov: Callable[[np.ndarray], np.ndarray]
    slopes: Callable[[np.ndarray], list[np.ndarray]]
    curves: Callable[[np.ndarray], dict[tuple[int, int], np.ndarray]]
    low: np.ndarray
    high: np.ndarray
    start: Callable[[float], np.ndarray]
    names: tuple[str, ...]


@dataclass(frozen=True)
class Mixed:
    params: dict[str, float]
    beta: np.ndarray
    cov_beta: np.ndarray
    eblup: np.ndarray
    effect: np.ndarray
    mse: np.ndarray
    loglik: float
    n_iter: int
    converged: bool
    info: np.ndarray
    aic: float
    bic: float


def two_fold(area: np.ndarray) -> Structure:
    same = (area[:, None] == area[None, :]).astype(float)
    eye = np.eye(len(area))
    return Structure(lambda t: t[0] * same + t[1] * eye, lambda t: [same, eye], lambda t: {}, np.zeros(2), np.full(2, np.inf), lambda m: np.array([m / 2, m / 2]), ("sigma2_v", "sigma2_u"))


def _sar(w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of (I - rho W')(I - rho W), and the derivative of the latter."""
    i = np.eye(len(w))
    a = i - rho * w
    return np.linalg.inv(a.T @ a), 2 * rho * w.T @ w - w - w.T


def spatial(w: np.ndarray) -> Structure:
    def slopes(t):
        s, c = _sar(w, t[1])
        return [s, -t[0] * s @ c @ s]

    def curves(t):
        s, c = _sar(w, t[1])
        scs = s @ c @ s
        return {(0, 1): -scs, (1, 1): t[0] * (2 * scs @ c @ s - 2 * s @ (w.T @ w) @ s)}

    return Structure(lambda t: t[0] * _sar(w, t[1])[0], slopes, curves, np.array([0.0, -0.999]), np.array([np.inf, 0.999]), lambda m: np.array([m, 0.5]), ("sigma2_u", "rho"))


def _ar(times: int, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AR(1) covariance for unit innovations and its first two derivatives by rho."""
    k = np.abs(np.subtract.outer(np.arange(times), np.arange(times))).astype(float)
    q = 1 - rho * rho
    power = lambda e: np.where(e < 0, 0.0, np.sign(rho) ** np.maximum(e, 0) * np.abs(rho) ** np.maximum(e, 0)) if rho else (e == 0).astype(float)
    r, r1, r2 = power(k), k * power(k - 1), k * (k - 1) * power(k - 2)
    return r / q, r1 / q + r * 2 * rho / q**2, r2 / q + 4 * rho * r1 / q**2 + r * (2 / q**2 + 8 * rho**2 / q**3)


def spatio_temporal(w: np.ndarray, times: int, correlated: bool = True) -> Structure:
    """Cells by area, then time; SAR area effects plus AR(1) (or independent) effects within areas."""
    ones, eye = np.ones((times, times)), np.eye(len(w))
    area = lambda m: np.kron(m, ones)

    def cov(t):
        own = t[2] * (_ar(times, t[3])[0] if correlated else np.eye(times))
        return area(t[0] * _sar(w, t[1])[0]) + np.kron(eye, own)

    def slopes(t):
        s, c = _sar(w, t[1])
        out = [area(s), area(-t[0] * s @ c @ s), np.kron(eye, _ar(times, t[3])[0] if correlated else np.eye(times))]
        return [*out, np.kron(eye, t[2] * _ar(times, t[3])[1])] if correlated else out

    def curves(t):
        s, c = _sar(w, t[1])
        scs = s @ c @ s
        out = {(0, 1): area(-scs), (1, 1): area(t[0] * (2 * scs @ c @ s - 2 * s @ (w.T @ w) @ s))}
        if correlated:
            _, d1, d2 = _ar(times, t[3])
            out |= {(2, 3): np.kron(eye, d1), (3, 3): np.kron(eye, t[2] * d2)}
        return out

    k = 4 if correlated else 3
    return Structure(cov, slopes, curves, np.array([0.0, -0.999, 0.0, -0.999])[:k], np.array([np.inf, 0.999, np.inf, 0.999])[:k], lambda m: np.array([m / 2, 0.5, m / 2, 0.5])[:k], ("sigma2_1", "rho_1", "sigma2_2", "rho_2")[:k])


def _state(y, x, psi, g, method):
    v = g + np.diag(psi)
    low = np.linalg.cholesky(v)
    half = np.linalg.solve(low, np.eye(len(v)))
    vi = half.T @ half
    q = np.linalg.inv(x.T @ vi @ x)
    beta = q @ (x.T @ (vi @ y))
    p = vi - vi @ x @ q @ x.T @ vi if method == "REML" else vi
    r = y - x @ beta
    logdet = 2 * np.log(np.diag(low)).sum()
    plain = -0.5 * (len(y) * math.log(2 * math.pi) + logdet + r @ vi @ r)
    aim = plain + 0.5 * np.linalg.slogdet(q)[1] if method == "REML" else plain
    return vi, q, beta, p, r, plain, aim


def fit(y: np.ndarray, x: np.ndarray, psi: np.ndarray, structure: Structure, method: str = "REML", maxiter: int = 100, precision: float = 1e-4, plain_unseen: bool = False) -> Mixed:
    """plain_unseen: cells that weren't sampled get g1 + g2 + g3 only. y holds NaN where nothing was sampled; x covers all cells. Scoring steps are halved until the likelihood doesn't fall, inside the bounds."""
    if len(y) > DENSE_MOST:
        raise ValueError(f"{len(y)} cells are more than dense algebra is made for ({DENSE_MOST})")
    s = np.flatnonzero(~np.isnan(y))
    ys, xs, ps = y[s], x[s], psi[s]
    sub = np.ix_(s, s)
    t = structure.start(float(np.median(ps)))
    state = _state(ys, xs, ps, structure.cov(t)[sub], method)
    converged, step = False, 0
    while step < maxiter and not converged:
        vi, _, _, p, r, _, aim = state
        ds = [d[sub] for d in structure.slopes(t)]
        pd = [p @ d for d in ds]
        pr = vi @ r
        score = np.array([-0.5 * np.trace(a) + 0.5 * pr @ d @ pr for a, d in zip(pd, ds, strict=True)])
        info = 0.5 * np.array([[np.sum(a * b.T) for b in pd] for a in pd])
        free = ~(((t <= structure.low) & (score <= 0)) | ((t >= structure.high) & (score >= 0)))
        move = np.zeros_like(t)
        if free.any():
            move[free] = np.linalg.lstsq(info[np.ix_(free, free)], score[free], rcond=None)[0]
        scale = 1.0
        for _ in range(30):
            new = np.clip(t + scale * move, structure.low, structure.high)
            try:
                tried = _state(ys, xs, ps, structure.cov(new)[sub], method)
            except np.linalg.LinAlgError:
                scale /= 2
                continue
            if tried[6] >= aim - 1e-10 * abs(aim):
                break
            scale /= 2
        converged = bool(np.max(np.abs(new - t) / (np.abs(t) + 1e-12)) <= precision)
        t, state, step = new, tried, step + 1
    vi, q, beta, p, r, plain, _ = state
    ds_all = structure.slopes(t)
    ds = [d[sub] for d in ds_all]
    pd = [p @ d for d in ds]
    info = 0.5 * np.array([[np.sum(a * b.T) for b in pd] for a in pd])
    inside = (t < structure.high) & ((t > structure.low) | (structure.low == 0))  # a correlation at its bound counts as fixed, a variance of 0 doesn't
    var = np.zeros_like(info)
    if inside.any():
        var[np.ix_(inside, inside)] = np.linalg.pinv(info[np.ix_(inside, inside)])
    g = structure.cov(t)
    cross = g[:, s]
    effect = cross @ (vi @ r)
    k = cross @ vi
    d = x - k @ xs
    g1 = np.diag(g) - np.sum(k * cross, axis=1)
    g2 = np.sum((d @ q) * d, axis=1)
    v = np.linalg.inv(vi)
    lines = [(dj[:, s] - k @ dj[sub]) @ vi for dj in ds_all]  # derivatives of the predictor's weights
    g3 = sum(var[i, j] * np.sum((lines[i] @ v) * lines[j], axis=1) for i in range(len(t)) for j in range(len(t)))
    seen = np.zeros(len(y), bool)
    seen[s] = True
    curve = np.zeros(len(y))
    for (i, j), dd in structure.curves(t).items():  # -1/2 of the second derivative of g1, times the parameters' covariance
        second = -(np.diag(dd) - 2 * np.sum(k * dd[:, s], axis=1) + np.sum((k @ dd[sub]) * k, axis=1))
        curve += 0.5 * (1 if i == j else 2) * var[i, j] * second
    bias = np.zeros(len(y))
    if method == "ML":
        full = vi - vi @ xs @ q @ xs.T @ vi
        shift = -0.5 * np.linalg.pinv(info) @ np.array([np.trace((vi - full) @ dj) for dj in ds])
        for j, dj in enumerate(ds_all):
            bias += shift[j] * (np.diag(dj) - 2 * np.sum(k * dj[:, s], axis=1) + np.sum((k @ dj[sub]) * k, axis=1))
    mse = g1 + g2 + np.where(seen | (not plain_unseen), 2 * g3 + curve, g3) - np.where(seen, bias, 0.0)  # the ML bias is taken off where y is known
    mse = np.where((mse < 0) & (mse > -1e-8), 0.0, mse)
    mse = np.where(mse < 0, np.nan, mse)
    count = len(beta) + len(t)
    return Mixed(dict(zip(structure.names, t.tolist(), strict=True)), beta, q, x @ beta + effect, effect, mse, float(plain), step, converged, info, -2 * plain + 2 * count, -2 * plain + count * math.log(len(s)))
