"""Beta-binomial kernels on numpy arrays, and pandas UDFs over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x, by Stirling's series after shifting to 10 and above."""
    x = np.array(x, float, copy=True)
    shift = np.zeros_like(x)
    low = x < 10
    while low.any():
        shift[low] -= np.log(x[low])
        x[low] += 1
        low = x < 10
    inv = 1 / x
    term, out = inv.copy(), (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi)
    for c in _STIRLING:
        out += c * term
        term *= inv * inv
    return out + shift


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float, copy=True)
    out = np.zeros_like(x)
    low = x < 10
    while low.any():
        out[low] -= 1 / x[low]
        x[low] += 1
        low = x < 10
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))


def shapes(mu: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = (1 - rho) / rho
    return mu * scale, (1 - mu) * scale


def log_pmf(k, n, mu, rho) -> np.ndarray:
    a, b = shapes(mu, rho)
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)


def cdf_pmf(k: np.ndarray, n: np.ndarray, mu: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X = k): the shorter tail is summed by the ratio of neighbouring terms."""
    k, n, mu, rho = (np.asarray(x, float) for x in (k, n, mu, rho))
    a, b = shapes(mu, rho)
    pk = np.exp(log_pmf(k, n, mu, rho))
    lower = k <= n - k
    total, term, i = np.where(lower, pk, 0.0), pk.copy(), k.copy()
    # downwards from k, or upwards from k + 1
    active = np.flatnonzero(lower & (k > 0))
    while len(active):
        x = i[active]
        term[active] *= x / (n[active] - x + 1) * (b[active] + n[active] - x) / (a[active] + x - 1)
        i[active] -= 1
        total[active] += term[active]
        active = active[(i[active] > 0) & (term[active] > total[active] * 1e-17)]
    active = np.flatnonzero(~lower & (k < n))
    while len(active):
        x = i[active]
        term[active] *= (n[active] - x) / (x + 1) * (a[active] + x) / (b[active] + n[active] - x - 1)
        i[active] += 1
        total[active] += term[active]
        active = active[(i[active] < n[active]) & (term[active] > total[active] * 1e-17)]
    return np.where(lower, total, 1 - total), pk


def two_sided(k, n, mu, rho, cap: float = 5e5) -> np.ndarray:
    """2 min(F(k), 1 - F(k) + f(k), 1/2); counts beyond ``cap`` are scaled down to it."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    big = n > cap
    k = np.where(big, np.minimum(np.round(k * cap / np.where(big, n, 1)), cap), k)
    n = np.where(big, cap, n)
    f, p = cdf_pmf(k, n, np.clip(mu, 1e-12, 1 - 1e-12), np.clip(rho, 1e-12, 1 - 1e-12))
    return 2 * np.minimum(np.minimum(np.minimum(f, 1.0), 1 - f + p), 0.5)


def _valid(*columns: pd.Series) -> np.ndarray:
    return ~np.any([c.isna().to_numpy() for c in columns], axis=0)


def _bb_p_value(k: pd.Series, n: pd.Series, mu: pd.Series, rho: pd.Series) -> pd.Series:
    ok = _valid(k, n, mu, rho)
    out = np.full(len(k), np.nan)
    out[ok] = two_sided(*(x.to_numpy(float)[ok] for x in (k, n, mu, rho)))
    return pd.Series(out)  # NaN becomes NULL


def _binomial_p_value(k: pd.Series, n: pd.Series, mu: pd.Series) -> pd.Series:
    """The same test with a binomial, the limit of no over-dispersion."""
    ok = _valid(k, n, mu)
    out = np.full(len(k), np.nan)
    kk, nn, m = (x.to_numpy(float)[ok] for x in (k, n, mu))
    m = np.clip(m, 1e-12, 1 - 1e-12)
    pk = np.exp(lgamma(nn + 1) - lgamma(kk + 1) - lgamma(nn - kk + 1) + kk * np.log(m) + (nn - kk) * np.log1p(-m))
    total, term, i = pk.copy(), pk.copy(), kk.copy()
    active = np.flatnonzero(kk > 0)
    while len(active):
        x = i[active]
        term[active] *= x / (nn[active] - x + 1) * (1 - m[active]) / m[active]
        i[active] -= 1
        total[active] += term[active]
        active = active[i[active] > 0]
    out[ok] = 2 * np.minimum(np.minimum(np.minimum(total, 1), 1 - total + pk), 0.5)
    return pd.Series(out)  # NaN becomes NULL


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function for x >= 0: its series below 3, Lentz's continued fraction above."""
    x = np.asarray(x, float)
    small = np.minimum(x, 3.0)
    term = total = small.copy()
    for i in range(1, 80):
        term = -term * small * small / i
        total = total + term / (2 * i + 1)
    low = 1 - 2 / math.sqrt(math.pi) * total
    big = np.maximum(x, 3.0)
    f = np.zeros_like(big)
    for i in range(60, 0, -1):
        f = i / 2 / (big + f)
    high = np.exp(-big * big) / math.sqrt(math.pi) / (big + f)
    return np.where(x < 3.0, low, high)


def _normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal."""
    return pd.Series(erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))


def fit_intercept(k: np.ndarray, n: np.ndarray, rounds: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """For each row the mean and dispersion of the greatest beta-binomial likelihood, by Newton steps on the logits of both with halving.

    Cells without reads say nothing; rows that are all 0 or all n end at the bounds.
    """
    seen = n > 0
    total = np.maximum(n.sum(axis=1), 1)
    start = np.clip(k.sum(axis=1) / total, 1e-4, 1 - 1e-4)
    at = np.stack([np.log(start / (1 - start)), np.full(len(k), -3.0)])

    def loss(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = np.clip(x, -25, 25)
        mu, rho = 1 / (1 + np.exp(-x[0])), 1 / (1 + np.exp(-x[1]))
        shape = np.ones((1, k.shape[1]))
        ll = log_pmf(k[rows], n[rows], mu[:, None] * shape, np.clip(rho, 1e-9, 1 - 1e-9)[:, None] * shape)
        return -np.where(seen[rows], ll, 0.0).sum(axis=1)

    active = np.arange(len(k))
    h = 1e-3
    for _ in range(rounds):
        if not len(active):
            break
        x = at[:, active]
        f = {(i, j): loss(x + np.array([[i * h], [j * h]]), active) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        g = np.stack([(f[1, 0] - f[-1, 0]) / (2 * h), (f[0, 1] - f[0, -1]) / (2 * h)])
        a, d = (f[1, 0] - 2 * f[0, 0] + f[-1, 0]) / h**2, (f[0, 1] - 2 * f[0, 0] + f[0, -1]) / h**2
        b = (f[1, 1] - f[1, -1] - f[-1, 1] + f[-1, -1]) / (4 * h**2)
        det = a * d - b * b
        good = (a > 1e-8) & (det > 1e-10)
        safe = np.where(good, det, 1.0)
        step = np.where(good, np.stack([(d * g[0] - b * g[1]) / safe, (a * g[1] - b * g[0]) / safe]), g)
        step *= np.minimum(1.0, 2.0 / np.maximum(np.abs(step).max(axis=0), 1e-300))
        size, better = np.ones(len(active)), np.zeros(len(active), bool)
        for _ in range(30):
            trial = np.clip(x - size * step, -20, 20)
            better = loss(trial, active) <= f[0, 0]
            if better.all():
                break
            size = np.where(better, size, size / 2)
        moved = np.where(better, np.clip(x - size * step, -20, 20), x)
        at[:, active] = moved
        active = active[np.abs(moved - x).max(axis=0) > tol ** 0.5]
    return 1 / (1 + np.exp(-at[0])), 1 / (1 + np.exp(-at[1]))


def fit_rho(k: np.ndarray, n: np.ndarray, mu: np.ndarray, low: float = -30, high: float = 30, penalty: float = 1e-4, tol: float = 1e-7) -> np.ndarray:
    """For each row the dispersion that minimises the penalised mean negative log-likelihood, by golden sections."""
    mu = np.clip(mu, 1e-9, 1 - 1e-9)
    seen = n > 0
    count = np.maximum(seen.sum(axis=1), 1)

    def loss(logit: np.ndarray) -> np.ndarray:
        rho = np.clip(1 / (1 + np.exp(-logit)), 1e-13, 1 - 1e-13)[:, None]
        ll = np.where(seen, log_pmf(k, n, mu, np.broadcast_to(rho, mu.shape)), 0.0)
        return -ll.sum(axis=1) / count + penalty * logit**2

    g = (math.sqrt(5) - 1) / 2
    a, b = np.full(len(k), low), np.full(len(k), high)
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    while (b - a).max(initial=0) > tol:
        left = fc < fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = loss(c), loss(d)
    return 1 / (1 + np.exp(-(a + b) / 2))


def bb_p_value(*columns) -> Column:
    """Two-sided beta-binomial p-value of columns k, n, mu, rho."""
    return F.pandas_udf(_bb_p_value, "double")(*columns)


def binomial_p_value(*columns) -> Column:
    return F.pandas_udf(_binomial_p_value, "double")(*columns)


def normal_p_value(z) -> Column:
    return F.pandas_udf(_normal_p_value, "double")(z)
