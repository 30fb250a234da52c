"""Simulated counts: beta-binomial with latent factors, and Dirichlet-multinomial within donor groups.

Every row draws from a generator seeded by its own number, so the result does not depend on
partitions or on lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "junction_id long, sample_id long, k long, n long, true_psi double, true_rho double"


def beta_binomial(spark: SparkSession, samples: int = 100, junctions: int = 500, q: int = 10, seed: int = 42) -> DataFrame:
    """Log-normal totals, mean from q latent factors of the samples, beta-binomial counts."""
    latent = np.random.default_rng(seed).normal(size=(samples, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j in b.id:
                rng = np.random.default_rng([seed, int(j)])
                size = np.exp(rng.normal(4, 1))
                n = rng.negative_binomial(5, 5 / (5 + size), samples)
                mu = 1 / (1 + np.exp(-(rng.normal(0, 2) + latent @ rng.normal(0, 0.3, q))))
                rho = float(np.clip(np.exp(rng.normal(-4, 1)), 1e-4, 0.5))
                a, c = mu * (1 - rho) / rho, (1 - mu) * (1 - rho) / rho
                psi = rng.beta(np.maximum(a, 1e-6), np.maximum(c, 1e-6))
                yield pd.DataFrame({"junction_id": j, "sample_id": np.arange(samples), "k": rng.binomial(n, psi), "n": n, "true_psi": mu, "true_rho": rho})

    return spark.range(junctions).mapInPandas(run, SCHEMA)


def dirichlet_multinomial(spark: SparkSession, samples: int = 100, junctions: int = 500, groups: int | None = None, seed: int = 42) -> DataFrame:
    """Junctions that share a donor split its reads: softmax means, Dirichlet shares, multinomial counts."""
    groups = groups or max(1, int(0.65 * junctions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g in b.id:
                ids = np.arange(g, junctions, groups)
                if not len(ids):
                    continue
                rng = np.random.default_rng([seed, 7, int(g)])
                weight = np.exp(rng.normal(0, 1.5, len(ids)))
                mu, rho = weight / weight.sum(), float(np.clip(np.exp(rng.normal(-4, 1)), 1e-4, 0.5))
                n = rng.negative_binomial(5, 5 / (5 + np.exp(rng.normal(4, 1))), samples)
                share = rng.dirichlet(np.maximum(mu * (1 - rho) / rho, 1e-6), samples)
                k = np.stack([rng.multinomial(t, p) for t, p in zip(n, share, strict=True)])
                yield pd.DataFrame({"junction_id": np.repeat(ids, samples), "sample_id": np.tile(np.arange(samples), len(ids)), "k": k.T.ravel(), "n": np.tile(n, len(ids)), "true_psi": np.repeat(mu, samples), "true_rho": rho})

    return spark.range(groups).mapInPandas(run, SCHEMA)
