"""Losses by numeric gradients, fits by plain numpy, and the analysis from counts to results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura import analysis, dataset
from junctura.functions import betabinomial as bb, losses
from junctura.operators import autoencoder, fitting, metrics, ranks, results
from junctura.sources import files, simulate
from junctura.sources.cohort import cohort


@pytest.fixture(scope="module")
def block():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 60, (5, 8)).astype(float)
    return {"n": n, "k": rng.binomial(n.astype(int), 0.4).astype(float), "h": rng.normal(size=(8, 2)), "d": rng.normal(size=(5, 2)), "b": rng.normal(size=5), "rho": rng.uniform(0.01, 0.3, 5)}


def numeric(f, x, h=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[i] += h
        down[i] -= h
        out[i] = (f(up) - f(down)) / (2 * h)
    return out


@pytest.mark.parametrize(("ridge", "weighted"), [(0.0, False), (0.3, True)])
def test_decoder_gradient(block, ridge, weighted):
    par = np.concatenate([block["b"][:, None], block["d"]], axis=1)
    w = np.random.default_rng(1).uniform(0, 1, block["k"].shape) if weighted else None
    f = lambda p: losses.decoder_loss(p, block["h"], block["k"], block["n"], block["rho"], 0.1, ridge, w)
    assert np.allclose(numeric(lambda p: f(p)[0].sum(), par), f(par)[1], atol=1e-5)


def test_encoder_gradient(block):
    f = lambda h: losses.encoder_loss(h, block["d"], block["b"], block["k"], block["n"], block["rho"])
    assert np.allclose(numeric(lambda h: f(h)[0], block["h"]), f(block["h"])[1], atol=1e-5)


def test_full_loss_is_the_likelihood(block):
    y = losses.predicted_logit(block["h"], block["d"], block["b"])
    mu = losses.predicted_mean(y)
    want = -bb.log_pmf(block["k"], block["n"], mu, block["rho"][:, None] * np.ones_like(mu)).mean(axis=1)
    assert np.allclose(losses.full_nll(y, block["k"], block["n"], block["rho"]), want)
    # the part that depends on the dispersion has the same differences
    other = np.full(5, 0.2)
    full = losses.full_nll(y, block["k"], block["n"], other) - want
    assert np.allclose(losses.rho_loss(other, mu, block["k"], block["n"]) - losses.rho_loss(block["rho"], mu, block["k"], block["n"]), full)


def test_extreme_predictions_stay_finite(block):
    for y in (-800.0, 800.0):
        grid = np.full(block["k"].shape, y)
        assert np.isfinite(losses.cell_loss(grid, block["k"], block["n"], block["rho"][:, None], 0.1)).all()
        assert (losses.cell_slope(grid, block["k"], block["n"], block["rho"][:, None], 0.1) == 0).all()


def test_minimiser_finds_the_bottom():
    target = np.array([[1.0, -2.0], [0.5, 3.0]])
    f = lambda x: (((x - target) ** 2 * [1, 25]).sum(axis=1), 2 * (x - target) * [1, 25])
    assert np.allclose(losses.minimise(f, np.zeros((2, 2)), 100, tol=1e-14), target, atol=1e-4)


def test_erfc():
    x = np.array([0.0, 0.1, 0.7, 1.5, 2.9, 3.1, 5.0, 9.0])
    assert np.allclose(bb.erfc(x), [math.erfc(v) for v in x], rtol=1e-9)


def test_intercept_fit_beats_its_neighbours():
    rng = np.random.default_rng(5)
    n = rng.integers(20, 80, (6, 60)).astype(float)
    p = rng.beta(0.3 * 19, 0.7 * 19, n.shape)
    k = rng.binomial(n.astype(int), p).astype(float)
    mu, rho = bb.fit_intercept(k, n)
    assert np.allclose(mu, 0.3, atol=0.05) and np.allclose(rho, 0.05, atol=0.03)
    ll = lambda m, r: bb.log_pmf(k, n, m[:, None] * np.ones_like(k), r[:, None] * np.ones_like(k)).sum(axis=1)
    best = ll(mu, rho)
    for dm, dr in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
        assert (ll(mu + dm, np.maximum(rho + dr, 1e-6)) <= best + 1e-9).all()


@pytest.fixture(scope="module")
def simulated(spark):
    df = simulate.beta_binomial(spark, 30, 60, 2, seed=4).withColumnRenamed("n", "n_jaccard")
    return df.withColumn("n_jaccard", F.greatest("n_jaccard", "k"))


def test_pca_fit_equals_numpy(simulated):
    rows = fitting.packed(simulated)
    got = {r.junction_id: np.array(r.mu) for r in fitting.fit_pca(rows, 2).collect()}
    table = {r.junction_id: (np.array(r.k), np.array(r.n)) for r in rows.collect()}
    x = np.stack([fitting.logits(*table[j], 0.1) for j in sorted(table)])
    base = x.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(x - base, full_matrices=False)
    want = 1 / (1 + np.exp(-(base + (u[:, :2] * s[:2]) @ vt[:2])))
    assert np.allclose(np.stack([got[j] for j in sorted(got)]), want, atol=1e-8)


def test_autoencoder_improves_on_its_start(simulated):
    rows = fitting.packed(simulated)
    start = sum(r.loss for r in autoencoder.fit_autoencoder(rows, 2, 0).collect())
    end = sum(r.loss for r in autoencoder.fit_autoencoder(rows, 2, 2).collect())
    decoder = sum(r.loss for r in autoencoder.fit_autoencoder(rows, 2, 1, encoder=False, weighted=True).collect())
    assert end < start and decoder < start * 1.05


def test_dimension_of_clear_factors(spark):
    df = simulate.beta_binomial(spark, 40, 120, 3, seed=9).withColumnRenamed("n", "n_jaccard").withColumn("n_jaccard", F.greatest("n_jaccard", "k"))
    assert 2 <= fitting.best_dimension(fitting.packed(df)) <= 12
    assert analysis.suggested_dimension(100) == 10 and analysis.suggested_dimension(3) == 2 and analysis.suggested_dimension(5000) == 100


def test_untested_rows_are_null(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [9.0, 9.0, 9.0]), (2, [6.0, 5.0, 7.0], [9.0, 9.0, 9.0])], fitting.PACKED)
    got = {r.junction_id: r for r in fitting.fit_beta_binomial(rows).collect()}
    assert got[1].mu is None and got[1].p is None and got[2].mu is not None and len(got[2].p) == 3


def test_injection_keeps_groups_and_depends_on_the_seed_alone(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    cells = metrics.prime_sites(ds).withColumn("n", F.col("k") + F.col("o_psi5")).join(metrics.site_index(ds, "psi5"), "junction_id")
    one = fitting.inject_outliers(cells.repartition(3), 0.05, 0.2, 7, "index", "n")
    two = fitting.inject_outliers(cells.repartition(7, "sample_id"), 0.05, 0.2, 7, "index", "n")
    key = lambda df: sorted((r.junction_id, r.sample_id, r.k_injected, r.injected) for r in df.collect())
    assert key(one) == key(two)
    assert one.filter("injected <> 0").count() > 0 and one.filter("k_injected < 0").isEmpty()
    sums = one.filter("injected <> 0").groupBy("index", "sample_id").agg(F.sum("delta_injected").alias("d"), F.count(F.lit(1)).alias("m"), F.sum(F.when(F.abs("injected") == 1, 1)).alias("moved"))
    assert {r.moved for r in sums.collect()} == {1}
    assert fitting.restored(one).columns == cells.columns
    assert fitting.true_outliers(one).filter("abs(outlier) > 1").isEmpty()


def test_precision_recall_by_hand(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (None, False)], "score double, label boolean")
    got = ranks.precision_recall_auc(df).first().auc
    # one of two found without a false one; then tp from 1 to 2 with one false one before them
    assert abs(got - (1 + (1 - math.log(3 / 2))) / 2) < 1e-9
    assert ranks.precision_recall_auc(df.filter("score > 2")).first().auc is None


def test_numbers_over_ranges(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("x")).repartition(5)
    assert {(r.x, r.number) for r in ranks.numbered(df, ["x"]).collect()} == {(i, i + 1) for i in range(100)}


@pytest.mark.parametrize("implementation", ["PCA", "PCA-regression", "BB"])
def test_analysis_finds_planted_outliers(spark, implementation):
    base = simulate.beta_binomial(spark, 30, 40, 1, seed=11).toPandas()
    # all samples use junction 7 alike but one, by less than would make a component of its own
    n = int(base.n.max()) + 50
    base["n"] = np.where(base.junction_id == 7, n, np.maximum(base.n, base.k))
    base["k"] = np.where(base.junction_id == 7, np.where(base.sample_id == 3, 0.6 * n, 0.8 * n), base.k).astype(int)
    cells = spark.createDataFrame(base[["junction_id", "sample_id", "k", "n"]].astype("int64")).withColumn("psi", F.col("k") / F.nullif("n", F.lit(0)))
    fitted = analysis.fit(cells, 1, implementation)
    tested = analysis.with_p_values(cells.join(fitted, ["junction_id", "sample_id"])).filter("junction_id = 7")
    best = tested.orderBy("p").first()
    assert best.sample_id == 3 and best.p < 0.01


def test_analysis_from_dataset_to_results(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    genes = ds.junctions.select("junction_id", F.concat(F.lit("g"), F.col("start_id") % 4).alias("gene"))
    subset = ds.samples.filter("sample_id < 20").select("sample_id", F.lit("g1").alias("gene"))
    done = analysis.analyse(ds, {"jaccard": 2}, ("jaccard",), genes=genes, subsets={"panel": subset})
    every = analysis.result_table(done, all_=True)
    assert every.count() == done.cells["jaccard"].count() and {"padjust_transcriptome_wide", "padjust_panel"} <= set(every.columns)
    assert every.filter("sample_id >= 20 and padjust_panel is not null").isEmpty() and not every.filter("padjust_panel is not null").isEmpty()
    loose = analysis.result_table(done, 1.0, 0.0, 0, aggregate=True, collapse=True)
    assert loose.groupBy("gene", "sample_id").count().filter("count > 1").isEmpty() and loose.filter("p_value_gene is null").isEmpty()
    with pytest.raises(ValueError, match="tested"):
        analysis.result_table(analysis.Analysis(ds))
    for bad in ({"implementation": "none"}, {"q": None}):
        with pytest.raises(ValueError):
            analysis.fit(done.cells["jaccard"], **{"q": 2, **bad})


def test_dataset_rules_and_accessors(spark, sf_dir, tmp_path):
    ds = cohort(spark, sf_dir)
    assert ds.checked() is ds
    assert dataset.resolved_metric("delta_PSI5_all") == "psi5" and dataset.feature_of("theta") == "site_id" and dataset.strand_mode("reverse") == 2 and dataset.strand_mode(True) == 1
    for call in (lambda: dataset.resolved_metric("psi"), lambda: dataset.strand_mode(3), lambda: dataset.strand_mode("maybe"), lambda: ds.counts("jaccard", "none"), lambda: dataset.checked_number(2, 0, 1)):
        with pytest.raises(ValueError):
            call()
    assert dataset.checked_number(None) is None and dataset.checked_number(0.5, 0, 1) == 0.5
    total = ds.counts("psi5", "total").join(ds.counts("psi5", "interest").withColumnRenamed("k", "own"), ["junction_id", "sample_id"]).join(ds.counts("psi5", "other").withColumnRenamed("k", "o"), ["junction_id", "sample_id"])
    assert total.filter("k <> own + o").isEmpty() and total.count() == ds.counts("jaccard").count()
    bad = ds.with_(name="a b", junctions=ds.junctions.unionByName(ds.junctions), j_counts=ds.j_counts.withColumn("k", -F.col("k")))
    assert len(bad.problems()) == 3
    with pytest.raises(ValueError, match="unique"):
        bad.checked()
    files.save(ds.with_(params={"q": 3}), str(tmp_path / "d"))
    back = files.load(spark, str(tmp_path / "d"))
    assert back.params == {"q": 3} and back.name == ds.name and back.j_counts.count() == ds.j_counts.count()
    assert files.is_saved(spark, str(tmp_path / "d"), ds.samples) and not files.is_saved(spark, str(tmp_path / "none"), ds.samples)
    judged = ds.junctions.select("junction_id", (F.col("junction_id") % 2 == 0).alias("passed"))
    kept = files.save_filtered(ds, judged, str(tmp_path / "out"))
    again = files.with_filtered(kept, str(tmp_path / "out"))
    assert kept.junctions.count() < ds.junctions.count() == again.junctions.count() and again.j_counts.count() == ds.j_counts.count()


def test_wide_tables_make_a_dataset(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    j = spark.createDataFrame([("chr1", 10, 20, 1, 2, 3, 0)], "seqname string, start int, end int, start_id int, end_id int, a int, b int")
    s = spark.createDataFrame([("chr1", 9, 10, 1, "Donor", 0, 4), ("chr1", 20, 21, 2, "Acceptor", 1, 0)], "seqname string, start int, end int, site_id int, type string, a int, b int")
    ds = files.dataset_from_wide(samples, j, s)
    assert ds.j_counts.collect()[0].k == 3 and ds.ss_counts.count() == 2
    with pytest.raises(ValueError, match="columns"):
        files.dataset_from_wide(samples, j.drop("b"), s)


def test_significant_digits(spark):
    got = [r.x for r in spark.createDataFrame([(0.123456789,), (0.0,), (None,), (12345678.0,)], "v double").select(results.signif("v").alias("x")).collect()]
    assert got == [0.12346, 0.0, None, 12346000.0]


@pytest.mark.parametrize("implementation", ["PCA", "BB", "AE"])
def test_from_alignments_to_results_of_every_metric(spark, sf_dir, implementation):
    from junctura.operators import counting
    from junctura.plans import counted

    reads = counted.alignments(spark, sf_dir).filter("seqname in ('chr1', 'chr2') and pos < 6000")
    ds = counting.count_dataset(reads, reads.select("sample_id").distinct(), min_expression=2)
    genes = ds.junctions.select("junction_id", F.concat(F.lit("g"), F.pmod(F.xxhash64("start_id"), F.lit(3))).alias("gene"))
    of = dataset.METRICS if implementation == "PCA" else ("jaccard", "theta")
    done = analysis.analyse(ds, 2, of, implementation, 1, genes=genes)
    table = analysis.result_table(done, all_=True)
    assert {r.type for r in table.select("type").distinct().collect()} == set(of)
    n_samples = ds.samples.count()
    assert table.filter("type = 'theta'").count() == ds.sites.count() * n_samples and table.filter("type = 'jaccard'").count() == ds.junctions.count() * n_samples
    assert table.filter("p_value < 0 or p_value > 1").isEmpty() and not table.filter("type = 'theta' and p_value is not null").isEmpty()


def test_cutoffs_of_genes_and_their_subsets(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    genes = ds.junctions.select("junction_id", F.concat(F.lit("g"), F.col("start_id") % 4).alias("gene"))
    subset = ds.samples.filter("sample_id < 20").select("sample_id", F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("gene"))
    done = analysis.analyse(ds, 2, ("jaccard",), genes=genes, subsets={"panel": subset})
    tested = done.gene_p["jaccard"].filter("p_gene is not null").count()
    every = analysis.result_table(done, aggregate=True, all_=True)
    assert every.count() == tested == analysis.result_table(done, None, None, None, aggregate=True).count() == analysis.result_table(done, 1.0, 0.0, 0, aggregate=True).count()
    panel = every.filter("padjust_panel is not null")
    assert not panel.isEmpty() and panel.filter("sample_id >= 20 or gene not in ('g1', 'g2')").isEmpty()
    # two tests of BY: the larger p-value times 3/2, the smaller one times 3 at most
    p = {(r.sample_id, r.gene): (r.p_gene, r.padj_gene) for r in done.subset_gene_p["jaccard"]["panel"].collect()}
    for s in {s for s, _ in p}:
        own = sorted(p[k] for k in p if k[0] == s and p[k][0] is not None)
        if len(own) == 2:
            high = min(1, own[1][0] * 1.5)
            assert abs(own[1][1] - high) < 1e-9 and abs(own[0][1] - min(high, own[0][0] * 3)) < 1e-9


def test_restored_junctions_bring_their_sites(spark, sf_dir, tmp_path):
    ds = cohort(spark, sf_dir)
    path = str(tmp_path / "out")
    kept = files.save_filtered(ds, ds.junctions.withColumn("passed", F.col("start_id") % 2 == 0), path)
    kept = files.save_filtered(kept, kept.junctions.withColumn("passed", F.col("start_id") % 4 == 0), path)
    back = files.with_filtered(kept, path)
    cells = lambda d: sorted(map(str, metrics.intron_jaccard(d).select("junction_id", "sample_id", "k", "nonsplit", "jaccard").collect()))
    assert kept.sites.count() < ds.sites.count() == back.sites.count() and cells(back) == cells(ds)
    assert back.ss_counts.count() == ds.ss_counts.count() and back.checked() is back


def test_a_saved_dataset_is_one_version(spark, sf_dir, tmp_path):
    import os

    ds, path = cohort(spark, sf_dir), str(tmp_path / "d")
    files.save(ds, path)
    files.save(files.load(spark, path), path)
    assert len([d for d in os.listdir(path) if d != "manifest"]) == 1 and files.load(spark, path).junctions.count() == ds.junctions.count()
    files.save(ds, path, keep_old=True)
    assert len([d for d in os.listdir(path) if d != "manifest"]) == 2
    with pytest.raises(FileExistsError):
        files.save(ds, path, rewrite=False)
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path / "none"))
