"""Encoder weights by numeric gradients and plain numpy, the search in one job, and the inverse of the incomplete beta function."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura import analysis
from junctura.functions import beta, losses
from junctura.operators import encoder, fitting, plots, ranks, results
from junctura.sources import simulate


@pytest.fixture(scope="module")
def cells(spark):
    df = simulate.beta_binomial(spark, 24, 80, 2, seed=5)
    df = df.withColumn("n", F.greatest("n", "k")).withColumn("psi", F.col("k") / F.nullif("n", F.lit(0))).withColumn("index", F.col("junction_id"))
    return spark.createDataFrame(df.toPandas())


@pytest.fixture(scope="module")
def rows(cells):
    return fitting.packed(cells, "k", "n")


def arrays(rows):
    table = sorted(rows.collect(), key=lambda r: r.junction_id)
    return np.array([r.k for r in table]), np.array([r.n for r in table])


def test_gradient_by_every_weight(rows):
    """The loss as a function of one weight for each junction and component."""
    k, n = arrays(rows)
    x = fitting.logits(k, n, 0.1)
    x -= x.mean(axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    e, d, b, rho = rng.normal(size=(len(k), 2)) / 50, rng.normal(size=(len(k), 2)), rng.normal(size=len(k)), rng.uniform(0.02, 0.3, len(k))
    f = lambda e: losses.encoder_loss(x.T @ e, d, b, k, n, rho)
    got = x @ f(e)[1]
    for i, j in [(0, 0), (3, 1), (17, 0), (79, 1)]:
        up, down = e.copy(), e.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        assert abs((f(up)[0] - f(down)[0]) / 2e-6 - got[i, j]) < 1e-3 * max(1, abs(got[i, j]))


def test_latent_values_are_inputs_times_weights(rows):
    done = encoder.fit_encoded(rows, 2, 2)
    k, n = arrays(rows)
    x = fitting.logits(k, n, 0.1)
    x -= x.mean(axis=1, keepdims=True)
    e = np.array([r.e for r in sorted(done.weights.collect(), key=lambda r: r.junction_id)])
    assert np.allclose(x.T @ e, done.latent, atol=1e-8)
    assert all(b <= a + 1e-9 for a, b in zip(done.losses[:-1], done.losses[1:], strict=True)) and done.losses[-1] < done.losses[0] - 1e-4


def test_steps_equal_those_over_single_weights(rows):
    """L-BFGS on the matrix A, under the Gram matrix, against the same on every weight of its own."""
    model = encoder.decoded(encoder.keyed(rows, 1), encoder.grams(encoder.keyed(rows, 1), 0.1, (0.0,))[0.0][0] @ encoder.leading(encoder.grams(encoder.keyed(rows, 1), 0.1, (0.0,))[0.0][0], 2), 0.1)
    model = rows.sparkSession.createDataFrame(model.toPandas(), model.schema)
    gram = encoder.grams(encoder.keyed(rows, 1), 0.1, (0.0,))[0.0][0]
    a0 = encoder.leading(gram, 2)
    a, loss = encoder.encoder_step(model, a0, gram, rounds=4, tol=0)
    table = sorted(model.collect(), key=lambda r: r.junction_id)
    k, n, d, b, rho = (np.array([getattr(r, c) for r in table]) for c in ("k", "n", "d", "b", "rho"))
    x = fitting.logits(k, n, 0.1)
    x -= x.mean(axis=1, keepdims=True)
    f = lambda e: (lambda v: (v[0], x @ v[1]))(losses.encoder_loss(x.T @ e, d, b, k, n, rho))
    e = x @ a0
    one, g = f(e)
    steps = []
    for _ in range(4):
        p, alphas = g.copy(), []
        for s, y in reversed(steps):
            alphas.append((s * p).sum() / (s * y).sum())
            p -= alphas[-1] * y
        p *= (steps[-1][0] * steps[-1][1]).sum() / (steps[-1][1] ** 2).sum() if steps else 1 / np.abs(x.T @ p).max()
        for (s, y), al in zip(steps, reversed(alphas), strict=True):
            p += (al - (y * p).sum() / (s * y).sum()) * s
        t = next(t for t in encoder.LENGTHS if f(e - t * p)[0] <= one - 1e-4 * t * (g * p).sum())
        new, new_g = f(e - t * p)
        steps.append((-t * p, new_g - g))
        e, one, g = e - t * p, new, new_g
    assert np.allclose(x @ a, e, atol=1e-7) and abs(one - loss) < 1e-7


def test_a_mask_limits_the_encoder_and_all_rows_are_fitted(rows, cells):
    mask = cells.select("junction_id").distinct().withColumn("included", F.col("junction_id") % 2 == 0)
    done = encoder.fit_encoded(rows, 2, 1, mask, weighted=True, noise=0.5, seed=3)
    assert {r.junction_id % 2 for r in done.weights.collect()} == {0} and done.fit.count() == rows.count()
    again = encoder.fit_encoded(rows.repartition(5), 2, 1, mask, weighted=True, noise=0.5, seed=3)
    other = encoder.fit_encoded(rows, 2, 1, mask, weighted=True, noise=0.5, seed=4)
    assert np.allclose(np.abs(done.latent), np.abs(again.latent), atol=1e-6) and not np.allclose(np.abs(done.latent), np.abs(other.latent), atol=1e-3)
    subset = analysis.encoder_subset(cells, 10, 0.05)
    assert subset.count() == 10 and subset.columns == ["junction_id", "included"]


@pytest.mark.parametrize("few", [0, 3])
def test_a_subset_too_small_for_the_components_gives_way_to_all_junctions(rows, cells, few):
    """In large cohorts no junction may deviate by what the subset asks for."""
    mask = cells.select("junction_id").distinct().withColumn("included", F.col("junction_id") < few)
    done, whole = encoder.fit_encoded(rows, 2, 1, mask, weighted=True), encoder.fit_encoded(rows, 2, 1, weighted=True)
    assert mask.filter("included").count() == few and done.weights.count() == done.fit.count() == rows.count()
    assert np.allclose(np.abs(done.latent), np.abs(whole.latent), atol=1e-8)


@pytest.mark.parametrize("implementation", ["PCA-reg-full", "PCA-BB-full", "PCA-BB-Decoder-no-weights", "fullAE", "AE-weighted"])
def test_every_method_fits(cells, implementation):
    got = analysis.fit(cells, 2, implementation, 1, n_subset=30, min_delta=0.05)
    assert got.count() == cells.count() and got.filter("mu <= 0 or mu >= 1 or mu is null or rho is null").isEmpty()


def test_search_over_both_axes_in_one_pass(spark, cells):
    got = {(r.q, r.noise): r.auc for r in analysis.injected_search(cells, [1, 3], freq=0.05, noise=(0.0, 1.0)).collect()}
    assert set(got) == {(1, 0.0), (3, 0.0), (1, 1.0), (3, 1.0)} and all(0 <= v <= 1 for v in got.values())
    # without noise each equals a fit of its own
    moved = fitting.inject_outliers(cells, 0.05, 0.2, 42, "index", "n").withColumn("k", F.col("k_injected")).withColumn("n", F.greatest("n", "k"))
    for q in (1, 3):
        tested = analysis.with_p_values(moved.join(analysis.fit(moved, q, "PCA"), ["junction_id", "sample_id"]))
        scored = tested.groupBy("index", "sample_id").agg((-F.min("p")).alias("score"), F.bool_or(F.col("injected") != 0).alias("label"))
        assert abs(ranks.precision_recall_auc(scored).first().auc - got[q, 0.0]) < 1e-6


def test_beta_functions_invert_each_other():
    p = np.array([1e-9, 0.025, 0.3, 0.5, 0.975, 1 - 1e-9])
    for a, b in [(1, 1), (1, 1e6), (3, 999_997), (500_000, 500_000), (0.3, 0.7), (2.5, 40), (1e6, 2)]:
        x = beta.beta_quantile(p, a, b)
        assert np.allclose(beta.beta_cdf(x, a, b), p, rtol=1e-8, atol=1e-12) and (np.diff(x) >= 0).all()
    # known ones: uniform, powers, and sums of binomial terms
    assert np.allclose(beta.beta_quantile(p, 1, 1), p) and np.allclose(beta.beta_quantile(p, 5, 1), p**0.2) and np.allclose(beta.beta_quantile(p, 1, 8), -np.expm1(np.log1p(-p) / 8))
    for x in (0.05, 0.4, 0.9):
        assert abs(beta.beta_cdf(x, 4, 7)[0] - sum(math.comb(10, i) * x**i * (1 - x) ** (10 - i) for i in range(4, 11))) < 1e-12
    assert beta.beta_quantile([0.3, 0.3, 0.0, 1.0], [2, 0, 2, 2], [0, 3, 2, 2]).tolist() == [1.0, 0.0, 0.0, 1.0]


def test_ribbon_holds_the_middle_of_its_distribution(spark):
    p = spark.range(400).select((F.col("id") % 2).alias("s"), F.col("id").alias("junction_id"), ((F.floor(F.col("id") / 2) + 0.5) / 200).alias("p"))
    points = results.qq(p, ["s"])
    got = plots.ribbon(points, ["s"], 0.05, None).collect()
    assert len(got) == 400 and all(r.lower <= r.upper for r in got)
    assert all(r.lower <= r.expected <= r.upper for r in got if 1 < r.rank < 190)
    one = next(r for r in got if r.rank == 1)
    assert abs(one.upper + math.log10(-math.expm1(math.log1p(-0.025) / 199))) < 1e-9
    assert plots.ribbon(points, ["s"], 0.05, 1).count() < 100
