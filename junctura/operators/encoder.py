"""Fits with an explicit encoder: a weight for each junction and component, fitted on a subset of junctions, then decoder and dispersion on all of them.

The latent values of the samples are h = sum over junctions of x_j e_j, x_j being a junction's centred logits over the samples and e_j its weights. The gradient of
the loss by e_j is x_j G with G the gradient by h, which is a sum over rows. So every step that L-BFGS takes from weights of the form e_j = x_j A stays in that form, for
one matrix A of samples x components: its inner products are those of A under C = sum of x_j' x_j, and h = C A. The weights of all junctions move, as
columns of Spark's rows would, while the driver holds samples x samples numbers only; a step tries several lengths in one pass over the rows.

Inputs may be corrupted by noise while the encoder is fitted: normal draws, a share of the standard deviation of their junction, that depend on
the seed and the junction alone. The latent values that the decoder gets at the end are those of clean inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import betabinomial as bb, losses
from ..sources import shared
from . import autoencoder, fitting

#: Lengths of a step that are tried in one pass.
LENGTHS = 4.0 ** -np.arange(7)


@dataclass(frozen=True)
class Encoded:
    """junction_id, mu (array over samples), rho and loss of all junctions; junction_id and e (array) of the subset; latent values of the samples; mean loss of the subset after each round."""

    fit: DataFrame
    weights: DataFrame
    latent: np.ndarray
    losses: list[float]


def keyed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with the number that their noise is drawn from."""
    return rows.withColumn("key", F.xxhash64(F.lit(seed), F.col("junction_id")))


def inputs(b: pd.DataFrame, pseudocount: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Centred logits of a block of rows, clean and corrupted."""
    x = fitting.logits(np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy()), pseudocount)
    clean = x - x.mean(axis=1, keepdims=True)
    if not noise:
        return clean, clean
    draws = np.stack([np.random.Generator(np.random.Philox(key=int(k) & (1 << 64) - 1)).standard_normal(x.shape[1]) for k in b.key])
    noisy = x + noise * x.std(axis=1, ddof=1, keepdims=True) * draws
    return clean, noisy - noisy.mean(axis=1, keepdims=True)


def grams(rows: DataFrame, pseudocount: float, noise: tuple[float, ...]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """For each noise the sums of the outer products of corrupted inputs, and of clean with corrupted ones, in one pass: samples squared numbers for each."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[float, list] = {}
        for b in batches:
            if len(b):
                for v in noise:
                    clean, noisy = inputs(b, pseudocount, v)
                    both = [noisy.T @ noisy, clean.T @ noisy]
                    total[v] = both if v not in total else [s + t for s, t in zip(total[v], both, strict=True)]
        for v, both in total.items():
            for which, m in enumerate(both):
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"noise": v, "which": which, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    found = rows.mapInPandas(partial, "noise double, which int, i int, j int, v double").groupBy("noise", "which", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(found.i.max()) + 1 if len(found) else 0
    out = {}
    for v in noise:
        both = []
        for which in (0, 1):
            own = found[(found.noise == v) & (found.which == which)]
            m = np.zeros((size, size))
            m[own.i, own.j] = own.v
            both.append(m)
        out[v] = tuple(both)
    return out


def leading(gram: np.ndarray, q: int) -> np.ndarray:
    """The matrix A of the first q principal components: their weights x_j A have unit length over the junctions."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:q]
    return vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))


def decoded(rows: DataFrame, h: np.ndarray, pseudocount: float) -> DataFrame:
    """Rows with decoder and intercept by least squares on the latent values, and dispersion."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n = np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy())
            x = fitting.logits(k, n, pseudocount)
            design = np.column_stack([np.ones(len(h)), h])
            par = np.linalg.lstsq(design, x.T, rcond=None)[0].T
            y = losses.predicted_logit(h, par[:, 1:], par[:, 0])
            rho = np.clip(bb.fit_rho(k, n, losses.predicted_mean(y)), 1e-6, 1 - 1e-6)
            yield pd.DataFrame({"junction_id": b.junction_id, "k": list(k), "n": list(n), "b": par[:, 0], "d": list(par[:, 1:]), "rho": rho, "loss": losses.full_nll(y, k, n, rho, pseudocount)})

    return rows.mapInPandas(run, autoencoder.model_schema(rows))


def evaluated(model: DataFrame, latents: list[np.ndarray], pseudocount: float) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient by the latent values at each of several of them, in one pass over the rows."""
    size = latents[0].size + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(latents), size))
        for b in batches:
            if len(b):
                k, n = np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy())
                d, base, rho = np.stack(b.d.to_numpy()), b.b.to_numpy(float), b.rho.to_numpy(float)
                for i, h in enumerate(latents):
                    loss, slope = losses.encoder_loss(h, d, base, k, n, rho, pseudocount)
                    total[i] += np.append(slope.ravel(), loss)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    v = model.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).sort("i").toPandas().v.to_numpy(float).reshape(len(latents), size)
    return [(float(x[-1]), x[:-1].reshape(latents[0].shape)) for x in v]


def encoder_step(model: DataFrame, a: np.ndarray, gram: np.ndarray, pseudocount: float = 0.1, rounds: int = 10, memory: int = 5, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """The encoder by L-BFGS, as its matrix A, and the loss; inner products are those of the weights of all junctions."""
    dot = lambda u, v: float((u * (gram @ v)).sum())
    ((loss, g),) = evaluated(model, [gram @ a], pseudocount)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        p, alphas = g.copy(), []
        for s, y, sy in reversed(steps):
            alphas.append(dot(s, p) / sy)
            p -= alphas[-1] * y
        if steps:
            s, y, sy = steps[-1]
            p *= sy / max(dot(y, y), 1e-300)
        else:
            p /= max(float(np.abs(gram @ p).max(initial=0)), 1e-300)
        for (s, y, sy), alpha in zip(steps, reversed(alphas), strict=True):
            p += (alpha - dot(y, p) / sy) * s
        slope = dot(g, p)
        if slope <= 0:
            p, slope = g.copy(), dot(g, g)
        if slope <= 1e-300:
            break
        tried = evaluated(model, [gram @ (a - t * p) for t in LENGTHS], pseudocount)
        fit = next((i for i, (new, _) in enumerate(tried) if new <= loss - 1e-4 * LENGTHS[i] * slope), None)
        if fit is None:
            break
        new, new_g = tried[fit]
        s, y = -LENGTHS[fit] * p, new_g - g
        if dot(s, y) > 1e-12 * dot(s, s):
            steps = [*steps, (s, y, dot(s, y))][-memory:]
        done = loss - new < tol * max(abs(loss), 1)
        a, loss, g = a + s, new, new_g
        if done:
            break
    return a, loss


def _alternated(model: DataFrame, h: np.ndarray, iterations: int, pseudocount: float, ridge: float, weighted: bool, tol: float) -> DataFrame:
    """Decoder and dispersion in turn until no row's loss changes by ``tol``."""
    for _ in range(iterations):
        new = shared.written(autoencoder.decoder_step(model, h, pseudocount, ridge, weighted), "decoder")
        change = new.select("junction_id", F.col("loss").alias("now")).join(model.select("junction_id", "loss"), "junction_id").agg(F.max(F.abs(F.col("now") - F.col("loss")))).first()[0]
        model = new
        if change is None or change < tol:
            break
    return model


def fit_encoded(
    rows: DataFrame, q: int, iterations: int = 15, included: DataFrame | None = None, encoder: bool = True, decoder: bool = True, weighted: bool = False, noise: float = 0.0, seed: int = 42, pseudocount: float = 0.1, ridge: float = 0.0, tol: float = 1e-5
) -> Encoded:
    """A fit of packed ``rows`` whose encoder sees the junctions of ``included`` (junction_id and included) only; or all, also where those are fewer than twice the components ``q``.

    Without ``encoder`` the latent values are those of the principal components of the subset; without ``decoder`` the decoder is the least-squares one. ``weighted`` by Huber weights in the last rounds, over all rows.
    """
    with shared.scratch():
        rows = shared.written(keyed(rows, seed), "packed")
        sub = rows if included is None else shared.written(rows.join(included.filter("included").select("junction_id").distinct(), "junction_id", "left_semi"), "subset")
        if included is not None and sub.count() < 2 * q:  # deviations shrink as counts grow, so a subset of variable junctions can be empty
            sub = rows
        gram, cross = grams(sub, pseudocount, (noise,))[noise]
        a = leading(gram, q)
        seen: list[float] = []
        if encoder:
            model = shared.written(decoded(sub, gram @ a, pseudocount), "subset-model")
            model = shared.written(autoencoder.decoder_step(model, gram @ a, pseudocount, ridge), "subset-model")
            seen.append(model.agg(F.avg("loss")).first()[0])
            for _ in range(iterations):
                a, _ = encoder_step(model, a, gram, pseudocount)
                model = shared.written(autoencoder.decoder_step(model, gram @ a, pseudocount, ridge), "subset-model")
                seen.append(model.agg(F.avg("loss")).first()[0])
                if abs(seen[-2] - seen[-1]) < tol:
                    break
        h = cross @ a
        model = shared.written(decoded(rows, h, pseudocount), "decoder")
        if decoder:
            model = _alternated(model, h, iterations, pseudocount, ridge, weighted, tol)

        def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    mu = losses.predicted_mean(losses.predicted_logit(h, np.stack(b.d.to_numpy()), b.b.to_numpy(float)))
                    yield pd.DataFrame({"junction_id": b.junction_id, "mu": list(mu), "rho": b.rho, "loss": b.loss})

        def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"junction_id": b.junction_id, "e": list(inputs(b, pseudocount, noise)[1] @ a)})

        fit = shared.written(model.mapInPandas(means, f"{fitting.id_field(rows)}, mu array<double>, rho double, loss double"), "fit", keep=True)
        return Encoded(fit, shared.written(sub.mapInPandas(weights, f"{fitting.id_field(rows)}, e array<double>"), "encoder", keep=True), h, seen)


def pca_models(rows: DataFrame, dimensions: list[int], noise: tuple[float, ...] = (0.0,), seed: int = 42, pseudocount: float = 0.1) -> DataFrame:
    """q, noise, junction_id and p (array over samples) of a principal-component fit for each number of components and each noise, all in one pass over the rows.

    The components are found in corrupted inputs, one Gram matrix for each noise; the fit projects clean ones.
    """
    rows = keyed(rows, seed)
    projections = []
    for v, (gram, _) in grams(rows, pseudocount, noise).items():
        values, vectors = np.linalg.eigh(gram)
        order = np.argsort(values)[::-1]
        projections += [(q, v, vectors[:, order[:q]] @ vectors[:, order[:q]].T) for q in dimensions]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n = np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy())
            x = fitting.logits(k, n, pseudocount)
            base = x.mean(axis=1, keepdims=True)
            for q, v, project in projections:
                mu = 1 / (1 + np.exp(-(base + (x - base) @ project)))
                rho = np.repeat(np.clip(bb.fit_rho(k, n, mu), 1e-9, 1 - 1e-9)[:, None], k.shape[1], axis=1)
                p = bb.two_sided(k.ravel(), n.ravel(), mu.ravel(), rho.ravel()).reshape(k.shape)
                yield pd.DataFrame({"q": q, "noise": v, "junction_id": b.junction_id, "p": list(p)})

    return rows.mapInPandas(run, f"q int, noise double, {fitting.id_field(rows)}, p array<double>")
