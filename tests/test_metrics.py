"""Hand-counted values of the splicing ratios, and the rules of p-value adjustment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.dataset import SpliceDataset
from junctura.functions import betabinomial as bb
from junctura.operators import filters, fitting, intervals, metrics, padjust, results
from junctura.sources import files


@pytest.fixture(scope="module")
def golden(spark):
    junctions = spark.createDataFrame([(1, "chr19", 7592515, 7592749, "*", 1, 2), (2, "chr19", 7594599, 7595171, "*", 3, 4), (3, "chr19", 7594599, 7595320, "*", 3, 5)], "junction_id long, seqname string, start int, end int, strand string, start_id long, end_id long")
    sites = spark.createDataFrame([(1, "chr19", 7592514, 7592515, "*", "Donor"), (2, "chr19", 7592749, 7592750, "*", "Acceptor"), (3, "chr19", 7594598, 7594599, "*", "Donor"), (4, "chr19", 7595171, 7595172, "*", "Acceptor"), (5, "chr19", 7595320, 7595321, "*", "Acceptor")], "site_id long, seqname string, start int, end int, strand string, type string")
    samples = spark.createDataFrame([("s3",), ("none",)], "sample_id string")
    j = spark.createDataFrame([(1, "s3", 2), (2, "s3", 10), (3, "s3", 1)], "junction_id long, sample_id string, k long")
    s = spark.createDataFrame([(1, "s3", 7), (2, "s3", 8), (5, "s3", 7)], "site_id long, sample_id string, k long")
    return SpliceDataset(samples, junctions, sites, j, s)


def test_golden_counts(golden):
    cells = {(r.sample_id, r.junction_id): r for r in metrics.intron_jaccard(golden).collect()}
    assert [cells["s3", j].o_psi5 for j in (1, 2, 3)] == [0, 1, 10]
    assert [cells["s3", j].o_psi3 for j in (1, 2, 3)] == [0, 0, 0]
    assert cells["s3", 1].n_jaccard == 2 + 0 + 0 + 15
    theta = {r.site_id: r.o_theta for r in metrics.site_theta(golden).filter("sample_id = 's3'").collect()}
    assert [theta[i] for i in range(1, 6)] == [2, 2, 11, 10, 1]


def test_nothing_over_nothing(golden):
    row = metrics.intron_jaccard(golden).filter("sample_id = 'none' and junction_id = 1").first()
    assert row.psi5 == 1.0 and row.psi3 == 1.0 and row.jaccard is None
    assert metrics.site_theta(golden).filter("sample_id = 'none'").agg(F.min("theta")).first()[0] == 1.0


def test_valid_and_saved(golden, spark, tmp_path):
    assert golden.problems() == []
    files.save(golden, str(tmp_path / "ds"))
    again = files.load(spark, str(tmp_path / "ds"))
    assert again.grid().count() == golden.grid().count() == 6
    assert again.subset(junctions=again.junctions.filter("junction_id = 3")).sites.count() == 2
    assert golden.with_(sites=golden.sites.union(spark.createDataFrame([(9, "c", 1, 2, "*", "Donor")], golden.sites.schema))).problems()


def _reference(p, method):
    m = len(p)
    order = np.argsort(p, kind="stable")
    v = np.array(p)[order]
    rank = np.arange(1, m + 1)
    out = np.empty(m)
    if method in ("BH", "BY"):
        c = 1 if method == "BH" else (1 / rank).sum()
        out[order] = np.minimum(1, np.minimum.accumulate((v * m / rank * c)[::-1])[::-1])
    elif method == "holm":
        out[order] = np.minimum(1, np.maximum.accumulate(v * (m - rank + 1)))
    elif method == "hochberg":
        out[order] = np.minimum(1, np.minimum.accumulate((v * (m - rank + 1))[::-1])[::-1])
    else:
        out = np.minimum(1, np.array(p) * m)
    return out


@pytest.mark.parametrize("method", padjust.METHODS[:-1])
def test_adjusted(spark, method):
    p = [0.01, 0.2, 0.03, 0.03, 0.9, 0.0004]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)] + [("a", 99, None), ("b", 0, None)], "s string, id int, p double")
    got = {(r.s, r.id): r.padj for r in padjust.adjusted(df, "p", ["s"], ["id"], method).collect()}
    assert np.allclose([got["a", i] for i in range(len(p))], _reference(p, method))
    assert got["a", 99] is None and got["b", 0] is None


def test_beta_binomial_kernels():
    from math import comb, lgamma

    x = np.array([0.1, 1.0, 3.5, 40.0, 1234.5])
    assert np.allclose(bb.lgamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    n, mu, rho = 9, 0.3, 0.1
    a, b = mu * 9, 0.7 * 9
    pmf = np.array([comb(n, k) * np.exp(lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)) for k in range(n + 1)])
    k = np.arange(n + 1)
    f, p = bb.cdf_pmf(k, np.full(n + 1, n), np.full(n + 1, mu), np.full(n + 1, rho))
    assert np.allclose(p, pmf) and np.allclose(f, np.cumsum(pmf))


def test_rho_and_dimension(spark):
    rng = np.random.default_rng(1)
    n = np.full((60, 40), 80.0)
    q = rng.beta(0.4 * 19, 0.6 * 19, n.shape)
    rho = bb.fit_rho(rng.binomial(80, q).astype(float), n, np.full(n.shape, 0.4))
    assert 0.03 < np.median(rho) < 0.07
    # Gavish and Donoho, table IV
    for beta, known, unknown in ((0.5, 1.98, 2.1711), (0.1, 1.58, 1.6089)):
        assert abs(fitting.threshold_coefficient(beta) - known) < 0.01
        assert abs(fitting.threshold_coefficient(beta) / np.sqrt(fitting.median_marchenko_pastur(beta)) - unknown) < 1e-3


def test_intervals(spark):
    schema = "id long, seqname string, start int, end int, strand string"
    rng = np.random.default_rng(3)
    mk = lambda n, w: [(i, f"c{rng.integers(2)}", int(s), int(s + rng.integers(w)), "+-*"[rng.integers(3)]) for i, s in enumerate(rng.integers(0, 3000, n))]
    a, b = mk(80, 300), mk(60, 30)
    met = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2] and (x[4] == y[4] or "*" in (x[4], y[4]))}
    got = intervals.overlap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 64).select("a.id", F.col("b.id").alias("y")).collect()
    assert len(got) == len(met) and {tuple(r) for r in got} == met
    near = {r.id: r.distance for r in intervals.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", "id").collect()}
    for x in a:
        assert near[x[0]] == min(max(0, y[2] - x[3] - 1, x[2] - y[3] - 1) for y in b if y[1] == x[1])


def test_cigar_introns(spark):
    df = spark.createDataFrame([("r1", "s", "c", "+", 100, "10M50N10M"), ("r2", "s", "c", "+", 95, "5S15M50N3I7M20N5M"), ("r3", "s", "c", "+", 1, "30M")], "read_id string, sample_id string, seqname string, strand string, pos int, cigar string")
    got = {(r.start, r.end): r.k for r in files.split_counts(df).collect()}
    assert got == {(110, 159): 2, (167, 186): 1}


def test_files(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1\t0\t10\ta\n")
    assert files.read_bed(spark, str(tmp_path / "x.bed")).first().start == 1
    (tmp_path / "x.gff").write_text('chr1\tz\texon\t5\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1"\n')
    row = files.read_gff(spark, str(tmp_path / "x.gff")).first()
    assert (row.gene_id, row.transcript_id, row.symbol) == ("G1", "T1", None)


def test_aberrant_treats_null_as_no(spark):
    df = spark.createDataFrame([(0.01, 0.5, 9), (None, 0.5, 9), (0.01, None, 9), (0.01, 0.5, 2)], "p double, d double, n int")
    got = [r.a for r in df.select(results.aberrant(F.col("p"), F.col("d"), F.col("n")).alias("a")).collect()]
    assert got == [True, False, False, False]


def test_filters(golden):
    judged = filters.expression_and_variability(metrics.intron_jaccard(golden), 5, min_quantile=0)
    passed, rest = filters.split_by_filter(golden, judged)
    assert [r.junction_id for r in passed.junctions.collect()] == [2] and rest.junctions.count() == 2
