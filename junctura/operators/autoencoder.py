"""A beta-binomial autoencoder over junctions: decoder and dispersion by row, latent values of the samples by sums over rows.

The model of a cell is logit mu = b_j + h_i . d_j, where the latent values of the samples h = X' E come from the centred logits X.
Rows stay in Spark: a step of the decoder is one map over rows, and the latent values, of which there are samples x q only, move along a gradient that is
a sum over rows. h moves within the span of X', which holds every h = X' E, so E itself (a row for each junction) never has to be on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import betabinomial as bb, losses
from ..sources import shared
from . import fitting



def model_schema(rows: DataFrame) -> str:
    return f"{fitting.id_field(rows)}, k array<double>, n array<double>, b double, d array<double>, rho double, loss double"


def _stacked(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy())


def start(rows: DataFrame, q: int, pseudocount: float = 0.1) -> tuple[np.ndarray, DataFrame]:
    """Latent values from the first q components, and rows with decoder, intercept and dispersion of that projection."""
    values, vectors = np.linalg.eigh(fitting.gram(rows, pseudocount))
    order = np.argsort(values)[::-1][:q]
    scale = np.sqrt(np.maximum(values[order], 1e-12))
    h = vectors[:, order] * scale / np.sqrt(max(len(values), 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n = _stacked(b)
            x = fitting.logits(k, n, pseudocount)
            base = x.mean(axis=1)
            d = np.linalg.lstsq(h, (x - base[:, None]).T, rcond=None)[0].T
            y = losses.predicted_logit(h, d, base)
            rho = np.clip(bb.fit_rho(k, n, losses.predicted_mean(y)), 1e-6, 1 - 1e-6)
            yield pd.DataFrame({"junction_id": b.junction_id, "k": list(k), "n": list(n), "b": base, "d": list(d), "rho": rho, "loss": losses.full_nll(y, k, n, rho, pseudocount)})

    return h, rows.mapInPandas(run, model_schema(rows))


def decoder_step(model: DataFrame, h: np.ndarray, pseudocount: float = 0.1, ridge: float = 0.0, weighted: bool = False, rounds: int = 30) -> DataFrame:
    """The decoder of each row by L-BFGS, then its dispersion; ``weighted`` by Huber weights of the cells' residuals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n = _stacked(b)
            rho = b.rho.to_numpy(float)
            par = np.concatenate([b.b.to_numpy(float)[:, None], np.stack(b.d.to_numpy())], axis=1)
            w = None
            if weighted:
                w = huber(k, n, losses.predicted_mean(losses.predicted_logit(h, par[:, 1:], par[:, 0])), rho[:, None])
            par = losses.minimise(lambda p: losses.decoder_loss(p, h, k, n, rho, pseudocount, ridge, w), par, rounds)
            y = losses.predicted_logit(h, par[:, 1:], par[:, 0])
            rho = np.clip(bb.fit_rho(k, n, losses.predicted_mean(y)), 1e-6, 1 - 1e-6)
            yield pd.DataFrame({"junction_id": b.junction_id, "k": list(k), "n": list(n), "b": par[:, 0], "d": list(par[:, 1:]), "rho": rho, "loss": losses.full_nll(y, k, n, rho, pseudocount)})

    return model.mapInPandas(run, model_schema(model))


def huber(k: np.ndarray, n: np.ndarray, mu: np.ndarray, rho: np.ndarray, c: float = 1.345) -> np.ndarray:
    """Huber weights of Pearson residuals; 0 where a cell has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(k - n * mu) / np.sqrt(n * mu * (1 - mu) * (1 + (n - 1) * rho))
        return np.where(np.isfinite(r), np.where(r > c, c / np.maximum(r, 1e-300), 1.0), 0.0)


def _gradient(model: DataFrame, h: np.ndarray, pseudocount: float) -> tuple[float, np.ndarray]:
    """Loss and gradient by the latent values, summed by Spark: samples x q numbers for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, slope = 0.0, np.zeros_like(h)
        for b in batches:
            if len(b):
                k, n = _stacked(b)
                one, g = losses.encoder_loss(h, np.stack(b.d.to_numpy()), b.b.to_numpy(float), k, n, b.rho.to_numpy(float), pseudocount)
                total, slope = total + one, slope + g
        yield pd.DataFrame({"i": np.arange(h.size + 1), "v": np.append(slope.ravel(), total)})

    v = model.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).sort("i").toPandas().v.to_numpy(float)
    return float(v[-1]), v[:-1].reshape(h.shape)


def latent_step(model: DataFrame, h: np.ndarray, pseudocount: float = 0.1, rounds: int = 5) -> np.ndarray:
    """Latent values along the gradient of the whole loss, by Barzilai-Borwein steps with halving."""
    loss, g = _gradient(model, h, pseudocount)
    step = 0.1 / max(float(np.abs(g).max(initial=0)), 1e-12)
    for _ in range(rounds):
        for _ in range(6):
            trial = h - step * g
            new, new_g = _gradient(model, trial, pseudocount)
            if new <= loss:
                break
            step /= 4
        else:
            return h
        ds, dg = trial - h, new_g - g
        step = abs(float((ds * dg).sum())) / max(float((dg * dg).sum()), 1e-300) or step
        h, loss, g = trial, new, new_g
    return h


def fit_autoencoder(rows: DataFrame, q: int, iterations: int = 15, pseudocount: float = 0.1, ridge: float = 0.0, weighted: bool = False, encoder: bool = True, tol: float = 1e-5) -> DataFrame:
    """junction_id, mu (array over samples), rho and loss.

    Decoder and latent values alternate until no row's loss changes by ``tol`` or for ``iterations`` rounds. Without ``encoder`` the latent values stay those of the
    principal components. Every round is written to the shared folder, which cuts the lineage.
    """
    h, model = start(rows, q, pseudocount)
    model = shared.written(model, "autoencoder")
    for _ in range(iterations):
        if encoder:
            h = latent_step(model, h, pseudocount)
        new = shared.written(decoder_step(model, h, pseudocount, ridge, weighted), "autoencoder")
        change = new.select("junction_id", F.col("loss").alias("now")).join(model.select("junction_id", "loss"), "junction_id").agg(F.max(F.abs(F.col("now") - F.col("loss")))).first()[0]
        model = new
        if change is None or change < tol:
            break

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                mu = losses.predicted_mean(losses.predicted_logit(h, np.stack(b.d.to_numpy()), b.b.to_numpy(float)))
                yield pd.DataFrame({"junction_id": b.junction_id, "mu": list(mu), "rho": b.rho, "loss": b.loss})

    return model.mapInPandas(run, f"{fitting.id_field(model)}, mu array<double>, rho double, loss double")
