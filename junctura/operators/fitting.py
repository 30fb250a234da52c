"""Model fits: latent correction by principal components, dispersion, and the number of components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import betabinomial as bb
from .ranks import draw

PACKED = "junction_id long, k array<double>, n array<double>"


def id_field(rows: DataFrame) -> str:
    """The junction_id of a schema, of whatever type ``rows`` has: numbers, or text where junctions were counted from alignments."""
    return f"junction_id {rows.schema['junction_id'].dataType.simpleString()}"


def packed(cells: DataFrame, k: str = "k", n: str = "n_jaccard") -> DataFrame:
    """One row for each junction with its counts in the order of sample_id."""
    rows = cells.groupBy("junction_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n")))).alias("x"))
    return rows.select("junction_id", F.col("x.k").alias("k"), F.col("x.n").alias("n"))


def logits(k: np.ndarray, n: np.ndarray, pseudocount: float) -> np.ndarray:
    return np.log((k + pseudocount) / (n - k + pseudocount))


def gram(rows: DataFrame, pseudocount: float = 0.1) -> np.ndarray:
    """The sum over junctions of the outer products of their centred logits: samples x samples, summed by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = logits(np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy()), pseudocount)
                x -= x.mean(axis=1, keepdims=True)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    found = rows.mapInPandas(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # samples squared
    size = int(found.i.max()) + 1 if len(found) else 0
    out = np.zeros((size, size))
    out[found.i, found.j] = found.v
    return out


def fit_pca(rows: DataFrame, q: int, pseudocount: float = 0.1) -> DataFrame:
    """junction_id, mu (array over samples) and rho: the projection on the first q components in sample space, then the dispersion."""
    values, vectors = np.linalg.eigh(gram(rows, pseudocount))
    top = vectors[:, np.argsort(values)[::-1][:q]]
    project = top @ top.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n = np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy())
            x = logits(k, n, pseudocount)
            base = x.mean(axis=1, keepdims=True)
            mu = 1 / (1 + np.exp(-(base + (x - base) @ project)))
            yield pd.DataFrame({"junction_id": b.junction_id, "mu": list(mu), "rho": bb.fit_rho(k, n, mu)})

    return rows.mapInPandas(run, f"{id_field(rows)}, mu array<double>, rho double")


def median_marchenko_pastur(beta: float) -> float:
    """The median of the Marchenko-Pastur law of aspect ratio beta, by quadrature after a cosine substitution."""
    lo, hi = (1 - np.sqrt(beta)) ** 2, (1 + np.sqrt(beta)) ** 2
    t = (np.arange(200_000) + 0.5) * np.pi / 200_000
    x = (lo + hi) / 2 - (hi - lo) / 2 * np.cos(t)
    density = np.sqrt(np.maximum((hi - x) * (x - lo), 0)) / (2 * np.pi * beta * x) * (hi - lo) / 2 * np.sin(t)
    share = np.cumsum(density)
    return float(np.interp(0.5, share / share[-1], x))


def threshold_coefficient(beta: float) -> float:
    """The optimal hard threshold for singular values when the noise level is known (Gavish and Donoho)."""
    return float(np.sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + np.sqrt(beta**2 + 14 * beta + 1))))


def best_dimension(rows: DataFrame, pseudocount: float = 0.1) -> int:
    """The number of components above the optimal threshold for an unknown noise level; 2 at least."""
    singular = np.sqrt(np.maximum(np.linalg.eigvalsh(gram(rows, pseudocount))[::-1], 0))
    m = len(singular)
    count = rows.count()
    if not m or not count:
        return 2
    beta = min(m, count) / max(m, count)
    cut = threshold_coefficient(beta) / np.sqrt(median_marchenko_pastur(beta)) * np.median(singular)
    return max(2, int((singular > cut).sum()))


def fit_beta_binomial(rows: DataFrame, min_count: int = 5) -> DataFrame:
    """junction_id, mu, rho and p-values of an intercept-only beta-binomial, mean and dispersion by maximum likelihood.

    Rows in which no sample has ``min_count`` reads are not tested: NULL throughout.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n = np.stack(b.k.to_numpy()), np.stack(b.n.to_numpy())
            test = k.max(axis=1) >= min_count
            mu, rho = np.full(len(k), np.nan), np.full(len(k), np.nan)
            p = np.full(k.shape, np.nan)
            if test.any():
                mu[test], rho[test] = bb.fit_intercept(k[test], n[test])
                shape = np.ones_like(k[test])
                p[test] = bb.two_sided(k[test].ravel(), n[test].ravel(), (mu[test, None] * shape).ravel(), (rho[test, None] * shape).ravel()).reshape(shape.shape)
            yield pd.DataFrame({"junction_id": b.junction_id, "mu": mu, "rho": rho, "p": list(p)})

    # a NaN leaves pandas as NULL
    found = rows.mapInPandas(run, f"{id_field(rows)}, mu double, rho double, p array<double>")
    return found.withColumn("p", F.when(F.col("mu").isNotNull(), F.col("p")))


def p_values(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """junction_id, position of the sample, p: the two-sided tests of a fit with a mean for each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, n, mu = (np.stack(b[c].to_numpy()) for c in ("k", "n", "mu"))
            rho = np.repeat(np.clip(b.rho.to_numpy(float), 1e-9, 1 - 1e-9)[:, None], k.shape[1], axis=1)
            yield pd.DataFrame({"junction_id": b.junction_id, "p": list(bb.two_sided(k.ravel(), n.ravel(), mu.ravel(), rho.ravel()).reshape(k.shape))})

    found = rows.join(fit, "junction_id").mapInPandas(run, f"{id_field(rows)}, p array<double>")
    return found.select("junction_id", F.posexplode("p").alias("sample", "p"))


def inject_outliers(cells: DataFrame, freq: float = 1e-3, delta: float = 0.2, seed: int = 42, index: str = "junction_id", n: str = "n_jaccard", method: str = "samplePSI", pseudocount: float = 0.1, metric: str | None = None, fixed: float | None = None) -> DataFrame:
    """Cells with k_injected, injected (1 or -1 for the moved junction, -2 or 2 for its siblings, 0 elsewhere) and delta_injected.

    A group (``index``) and sample is picked with probability ``freq``; one of its junctions moves by a draw between ``delta`` and all the room there is, the
    other way where there is less room than ``delta``; its siblings share the opposite change in proportion to their ratios, so that
    the group's sum stays. Ratios are those of the sample, of the junction's mean (meanPSI) or a column true_psi (simulatedPSI). All draws are hashes
    of seed, group and sample. With ``fixed`` a junction moves by so much, as far as there is room.

    ``metric`` has its rules: sites of theta are picked a tenth as often, as there are so many more of them, and groups of psi5 and psi3 need two junctions at least.
    """
    pc = pseudocount
    if metric == "theta":
        freq = freq / 10
    own = (F.col("k") + pc) / (F.col(n) + 2 * pc)
    psi = {"samplePSI": own, "meanPSI": F.avg(own).over(Window.partitionBy("junction_id")), "simulatedPSI": F.col("true_psi") if "true_psi" in cells.columns else own}[method]
    group = Window.partitionBy(index, "sample_id")
    out = cells.withColumns({"_psi": psi, "_u": draw(seed, index, "sample_id")}).withColumn("_size", F.count(F.lit(1)).over(group))
    # the junction that moves: the first by a hash of its own
    out = out.withColumn("_moves", F.row_number().over(group.orderBy(draw(seed + 1, "junction_id", "sample_id"), "junction_id")) == 1)
    at = F.first(F.when(F.col("_moves"), F.col("_psi")), ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumns({"_at": at, "_sign": F.when(F.col("_u") < freq / 2, 1).otherwise(-1)})
    room = lambda sign: F.when(sign > 0, 1 - F.col("_at")).otherwise(F.col("_at"))
    out = out.withColumn("_sign", F.when(room(F.col("_sign")) < delta, -F.col("_sign")).otherwise(F.col("_sign"))).withColumn("_room", room(F.col("_sign")))
    least = F.least(F.lit(delta), F.col("_room"))
    by = F.least(F.lit(fixed), F.col("_room")) if fixed is not None else least + (F.col("_room") - least) * draw(seed + 2, index, "sample_id")
    out = out.withColumn("_d", F.col("_sign") * by)
    change = F.when(F.col("_moves"), F.col("_d")).otherwise(-F.col("_psi") / F.nullif(1 - F.col("_at"), F.lit(0.0)) * F.col("_d"))
    hit = (F.col("_u") < freq) & (F.col("_size") > 1 if metric in ("psi5", "psi3") else F.lit(True))
    moved = F.greatest(F.lit(0.0), F.bround((F.col("_psi") + change) * (F.col(n) + 2 * pc) - pc))
    moved = F.when(F.col("_size") == 1, F.least(moved, F.col(n).cast("double"))).otherwise(moved).cast("long")
    sign = F.when(F.col("_moves"), F.col("_sign")).otherwise(-2 * F.col("_sign"))
    out = out.withColumns({"injected": F.when(hit, sign).otherwise(0), "delta_injected": F.when(hit, change).otherwise(0.0), "k_injected": F.when(hit, moved).otherwise(F.col("k"))})
    return out.drop("_psi", "_u", "_size", "_moves", "_at", "_sign", "_room", "_d")


def true_outliers(injected: DataFrame) -> DataFrame:
    """junction_id, sample_id and the direction of what was injected: moved siblings count by their direction, too."""
    return injected.select("junction_id", "sample_id", F.greatest(F.lit(-1), F.least(F.lit(1), F.col("injected"))).alias("outlier"), "delta_injected")


def restored(injected: DataFrame) -> DataFrame:
    """The cells without what was injected."""
    return injected.drop("injected", "delta_injected", "k_injected")
