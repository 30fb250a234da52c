"""The incomplete beta function and its inverse, on numpy arrays and as a pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .betabinomial import lgamma

_TINY = 1e-300


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method, for x below its mean."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    out = d.copy()
    live = np.arange(len(x))
    m = 0
    while len(live) and m < 20_000:
        m += 1
        xs, as_, bs = x[live], a[live], b[live]
        change = np.ones(len(live))
        for t in (m * (bs - m) * xs / ((as_ + 2 * m - 1) * (as_ + 2 * m)), -(as_ + m) * (as_ + bs + m) * xs / ((as_ + 2 * m) * (as_ + 2 * m + 1))):
            dd, cc = 1 + t * d[live], 1 + t / c[live]
            d[live] = 1 / np.where(np.abs(dd) < _TINY, _TINY, dd)
            c[live] = np.where(np.abs(cc) < _TINY, _TINY, cc)
            change = d[live] * c[live]
            out[live] *= change
        live = live[np.abs(change - 1) > 1e-15]
    return out


def beta_cdf(x, a, b) -> np.ndarray:
    """P(X <= x) of a beta distribution with shapes above 0."""
    x, a, b = (v.astype(float).ravel() for v in np.broadcast_arrays(x, a, b))
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(z) + b * np.log1p(-z))
    turn = z > (a + 1) / (a + b + 2)
    p, q, r = np.where(turn, 1 - z, z), np.where(turn, b, a), np.where(turn, a, b)
    low = front * _fraction(p, q, r) / q
    return np.where(inside, np.clip(np.where(turn, 1 - low, low), 0, 1), (x >= 1).astype(float))


def beta_quantile(p, a, b) -> np.ndarray:
    """The x with P(X <= x) = p: Newton steps on the log-odds of x, kept within a bracket that each step narrows. With b = 0 it is 1, with a = 0 it is 0, as in the limit."""
    p, a, b = (v.astype(float).ravel() for v in np.broadcast_arrays(p, a, b))
    out = np.full(len(p), np.nan)
    out[(p == 1) | (b == 0)] = 1.0
    out[(p == 0) | (a == 0) & (b > 0)] = 0.0
    live = np.flatnonzero((p > 0) & (p < 1) & (a > 0) & (b > 0))
    low, high = np.full(len(p), -745.0), np.full(len(p), 745.0)
    t = np.zeros(len(p))
    t[live] = np.log(a[live] / b[live])
    for _ in range(200):
        if not len(live):
            break
        u, aa, bb = t[live], a[live], b[live]
        x = 1 / (1 + np.exp(-u))
        f = beta_cdf(x, aa, bb) - p[live]
        low[live], high[live] = np.where(f < 0, u, low[live]), np.where(f < 0, high[live], u)
        # log x and log(1 - x) without loss at the ends
        slope = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) - aa * np.logaddexp(0, -u) - bb * np.logaddexp(0, u))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = u - f / slope
        good = np.isfinite(step) & (step > low[live]) & (step < high[live])
        t[live] = np.where(good, step, (low[live] + high[live]) / 2)
        out[live] = 1 / (1 + np.exp(-t[live]))
        live = live[(np.abs(t[live] - u) > 1e-13 * np.maximum(1, np.abs(u))) & (f != 0)]
    return out


def _quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p, a, b))


def quantile(p: Column, a: Column, b: Column) -> Column:
    """The quantile of a beta distribution as a column; NULL for a missing p or shape."""
    return F.nanvl(F.pandas_udf(_quantile, "double")(p.cast("double"), a.cast("double"), b.cast("double")), F.lit(None).cast("double"))
