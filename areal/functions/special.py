"""Distribution functions that neither Spark SQL nor NumPy has."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_cdf(x):
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(x)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_tail(z):
    """Two-sided p-value of a standard normal statistic."""
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(z)


def chi2_tail(x: float, df: float) -> float:
    """P(X > x): series for small x, continued fraction otherwise."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= h / k
            total += term
        return 1 - front * total
    b, c, d = h + 1 - a, 1e300, 1 / (h + 1 - a)
    out = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b) if an * d + b else 1e300
        c = b + an / c if c else 1e300
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def ks_tail(d: float, n: int) -> float:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return 1.0 if t < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def log_gamma(x):
    """ln Gamma(x) for x > 0, by Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - shift


def digamma(x):
    x = np.asarray(x, float)
    z = x + 8
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - sum(1 / (x + k) for k in range(8))


def trigamma(x):
    x = np.asarray(x, float)
    z = x + 8
    return 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) + sum(1 / (x + k) ** 2 for k in range(8))


def log_beta(a, b):
    return log_gamma(a) + log_gamma(b) - log_gamma(np.asarray(a, float) + b)


def log_sum_exp(x, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.item() if axis is None else np.squeeze(out, axis)


def binomial_pmf(k, n, p):
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p))
    return np.where((k < 0) | (k > n), 0.0, np.where(p <= 0, k == 0, np.where(p >= 1, k == n, inside)))


def poisson_pmf(k, mean):
    k, mean = np.asarray(k, float), np.asarray(mean, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.exp(k * np.log(mean) - mean - log_gamma(np.maximum(k, 0) + 1))
    return np.where(k < 0, 0.0, np.where(mean <= 0, k == 0, inside))


def binomial_cdf(k: int, n: int, p) -> np.ndarray:
    """P(X <= k) for one k and n and any shape of p."""
    return np.minimum(sum((binomial_pmf(j, n, p) for j in range(int(k) + 1)), np.zeros(np.shape(p))), 1.0)


def poisson_cdf(k: int, mean) -> np.ndarray:
    return np.minimum(sum((poisson_pmf(j, mean) for j in range(int(k) + 1)), np.zeros(np.shape(mean))), 1.0)
