"""Losses of a low-rank beta-binomial model and their gradients, on numpy arrays.

A row is a junction, a column a sample. Its logit mean is y = h d + b, h being the latent values of the samples. With
a = p (1 - rho) / rho and c = (1 - p) (1 - rho) / rho the truncated loss of a cell, that is without what does not depend on y, is
log G(a) + log G(c) - log G(k + a) - log G(n - k + c). Counts get a pseudocount in it. All losses are means over samples.
"""

from __future__ import annotations

import numpy as np

from .betabinomial import digamma, lgamma

#: |y| beyond this is cut: p would be 0 or 1 in floating point and its gradient 0.
MOST = 30.0


def predicted_logit(h: np.ndarray, d: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows x samples."""
    return d @ h.T + b[:, None]


def predicted_mean(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -MOST, MOST)))


def _parts(y: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p = predicted_mean(y)
    scale = (1 - rho) / rho
    return p, scale, np.maximum(p * scale, 1e-300), np.maximum((1 - p) * scale, 1e-300)


def cell_loss(y: np.ndarray, k: np.ndarray, n: np.ndarray, rho: np.ndarray, pseudocount: float) -> np.ndarray:
    _, _, a, c = _parts(y, rho)
    return lgamma(a) + lgamma(c) - lgamma(k + a + pseudocount) - lgamma(n - k + c + pseudocount)


def cell_slope(y: np.ndarray, k: np.ndarray, n: np.ndarray, rho: np.ndarray, pseudocount: float) -> np.ndarray:
    """The derivative of ``cell_loss`` by y."""
    p, scale, a, c = _parts(y, rho)
    out = p * (1 - p) * scale * (digamma(a) - digamma(c) - digamma(k + a + pseudocount) + digamma(n - k + c + pseudocount))
    return np.where(np.abs(y) >= MOST, 0.0, out)


def decoder_loss(par: np.ndarray, h: np.ndarray, k: np.ndarray, n: np.ndarray, rho: np.ndarray, pseudocount: float = 0.1, ridge: float = 0.0, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row, and its gradient by par = (b, d) (rows x 1 + q); ``weights`` of cells may tell less of outliers."""
    b, d = par[:, 0], par[:, 1:]
    y, m = predicted_logit(h, d, b), k.shape[1]
    w = 1.0 if weights is None else weights
    loss = (w * cell_loss(y, k, n, rho[:, None], pseudocount)).sum(axis=1) / m + ridge / m * (d * d).sum(axis=1)
    slope = w * cell_slope(y, k, n, rho[:, None], pseudocount) / m
    return loss, np.concatenate([slope.sum(axis=1, keepdims=True), slope @ h + 2 * ridge / m * d], axis=1)


def encoder_loss(h: np.ndarray, d: np.ndarray, b: np.ndarray, k: np.ndarray, n: np.ndarray, rho: np.ndarray, pseudocount: float = 0.1) -> tuple[float, np.ndarray]:
    """The sum over rows of a block, and its gradient by the latent values h of the samples.

    With encoder weights E (rows x q) the latent values are h = x' E, so the gradient by E is x times this one: a block needs no other block's rows.
    """
    y, m = predicted_logit(h, d, b), k.shape[1]
    slope = cell_slope(y, k, n, rho[:, None], pseudocount) / m
    return float(cell_loss(y, k, n, rho[:, None], pseudocount).sum() / m), slope.T @ d


def full_nll(y: np.ndarray, k: np.ndarray, n: np.ndarray, rho: np.ndarray, pseudocount: float = 0.0, d: np.ndarray | None = None, ridge: float = 0.0) -> np.ndarray:
    """The complete mean negative log-likelihood of each row, with a penalty on its decoder."""
    r = rho[:, None]
    scale = (1 - r) / r
    out = cell_loss(y, k, n, r, pseudocount) - lgamma(scale * np.ones_like(y)) + lgamma(n + scale + 2 * pseudocount) - lgamma(n + 1 + 2 * pseudocount) + lgamma(k + 1 + pseudocount) + lgamma(n - k + 1 + pseudocount)
    out = out.mean(axis=1)
    return out if d is None else out + ridge / k.shape[1] * (d * d).sum(axis=1)


def rho_loss(rho: np.ndarray, mu: np.ndarray, k: np.ndarray, n: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """The part of the mean negative log-likelihood that depends on the dispersion, with a penalty on its logit."""
    mu = np.clip(mu, 1e-12, 1 - 1e-12)
    y = np.log(mu / (1 - mu))
    scale = ((1 - rho) / rho)[:, None] * np.ones_like(y)
    out = cell_loss(y, k, n, rho[:, None], 0.0) - lgamma(scale) + lgamma(n + scale)
    return out.mean(axis=1) + penalty * np.log(rho / (1 - rho)) ** 2


def moments_rho(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Dispersion by the method of moments: the excess of the weighted variance of ratios over the binomial one, within 0 and 1."""
    n = np.maximum(n, 0.0)
    total = np.maximum(n.sum(axis=1), 1)
    mu = k.sum(axis=1) / total
    ratio = k / np.maximum(n, 1)
    m = np.maximum((n > 0).sum(axis=1), 2)
    s = (n * (ratio - mu[:, None]) ** 2).sum(axis=1)
    base = mu * (1 - mu)
    spread = np.maximum(total - (n * n).sum(axis=1) / total, 1e-12)
    return np.clip((s - base * (m - 1)) / np.maximum(base * (spread - (m - 1)), 1e-12), 1e-9, 1 - 1e-9)


def minimise(f, x: np.ndarray, rounds: int = 50, memory: int = 6, tol: float = 1e-6) -> np.ndarray:
    """Rows of parameters that each minimise their own loss, by L-BFGS with halving steps; ``f`` gives loss and gradient of all rows."""
    x = x.copy()
    loss, g = f(x)
    s_all, y_all = [], []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(list(zip(s_all, y_all, strict=True))):
            sy = (s * y).sum(axis=1)
            a = np.where(sy > 1e-12, (s * q).sum(axis=1) / np.where(sy > 1e-12, sy, 1), 0.0)
            q -= a[:, None] * np.where((sy > 1e-12)[:, None], y, 0)
            alphas.append(a)
        if s_all:
            sy, yy = (s_all[-1] * y_all[-1]).sum(axis=1), (y_all[-1] ** 2).sum(axis=1)
            q *= np.where((sy > 1e-12) & (yy > 0), sy / np.where(yy > 0, yy, 1), 1.0)[:, None]
        else:
            q /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1.0)
        for (s, y), a in zip(zip(s_all, y_all, strict=True), reversed(alphas), strict=True):
            sy = (s * y).sum(axis=1)
            b = np.where(sy > 1e-12, (y * q).sum(axis=1) / np.where(sy > 1e-12, sy, 1), 0.0)
            q += (np.where(sy > 1e-12, a - b, 0.0))[:, None] * s
        down = (q * g).sum(axis=1) > 0
        q = np.where(down[:, None], q, g)
        step, slope = np.ones(len(x)), (q * g).sum(axis=1)
        for _ in range(25):
            trial = x - step[:, None] * q
            new, new_g = f(trial)
            ok = new <= loss - 1e-4 * step * slope
            if ok.all():
                break
            step = np.where(ok, step, step / 2)
        ok = new <= loss
        moved = np.where(ok[:, None], trial, x)
        new, new_g = np.where(ok, new, loss), np.where(ok[:, None], new_g, g)
        s_all, y_all = [*s_all, moved - x][-memory:], [*y_all, new_g - g][-memory:]
        done = np.abs(loss - new).max(initial=0) < tol
        x, loss, g = moved, new, new_g
        if done:
            break
    return x
