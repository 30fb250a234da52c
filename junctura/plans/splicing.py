"""Queries over the cohort: counts, ratios, filters, tests and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import betabinomial as bb
from ..operators import filters, metrics, padjust
from ..sources.cohort import COHORT_SQL, cohort, jaccard_cells, once

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = ""):
    """Registers a function of (spark, sf_dir) under its name, and SQL that may use the cohort's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {COHORT_SQL}{base}\n{sql}"
        return f

    return add


def rounded(df, *columns: str, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


METRICS_SQL = """,
prime AS (SELECT g.*, CASE WHEN strand = '-' THEN e ELSE s END - k AS o_psi5, CASE WHEN strand = '-' THEN s ELSE e END - k AS o_psi3
  FROM (SELECT *, sum(k) OVER (PARTITION BY sample_id, strand = '-', seqname, start) AS s, sum(k) OVER (PARTITION BY sample_id, strand = '-', seqname, "end") AS e FROM grid) g),
nonsplit AS (SELECT junction_id, sample_id, sum(sc.k) AS ns FROM sc JOIN (SELECT junction_id, start_id AS site_id FROM junctions UNION ALL SELECT junction_id, end_id FROM junctions) USING (site_id) GROUP BY ALL),
m AS (SELECT p.*, coalesce(k / nullif(k + o_psi5, 0)::DOUBLE, 1.0) AS psi5, coalesce(k / nullif(k + o_psi3, 0)::DOUBLE, 1.0) AS psi3, coalesce(ns, 0) AS nonsplit, k + o_psi3 + o_psi5 + coalesce(ns, 0) AS n_jaccard, k / nullif(k + o_psi3 + o_psi5 + coalesce(ns, 0), 0)::DOUBLE AS jaccard
  FROM prime p LEFT JOIN nonsplit USING (junction_id, sample_id)),
th AS (SELECT s.*, coalesce(o, 0) AS o_theta, coalesce(k / nullif(k + coalesce(o, 0), 0)::DOUBLE, 1.0) AS theta FROM sgrid s LEFT JOIN
  (SELECT site_id, sample_id, sum(k) AS o FROM jc JOIN (SELECT junction_id, start_id AS site_id FROM junctions UNION SELECT junction_id, end_id FROM junctions) USING (junction_id) GROUP BY ALL) USING (site_id, sample_id))"""


@query("SELECT junction_id, sample_id, k::BIGINT AS k FROM jc")
def split_read_counts(spark, sf_dir):
    return cohort(spark, sf_dir).j_counts.select("junction_id", "sample_id", "k")


@query("SELECT junction_id, seqname, start, \"end\", strand, sample_id, k::BIGINT AS k FROM grid")
def merged_counts(spark, sf_dir):
    return cohort(spark, sf_dir).grid().select("junction_id", "seqname", "start", "end", "strand", "sample_id", "k")


@query("SELECT site_id, seqname, start, \"end\", strand, type FROM sites")
def splice_sites(spark, sf_dir):
    return cohort(spark, sf_dir).sites


@query("SELECT site_id, sample_id, k::BIGINT AS k FROM sgrid")
def nonsplit_site_counts(spark, sf_dir):
    return cohort(spark, sf_dir).site_grid().select("site_id", "sample_id", "k")


@query("SELECT junction_id, sample_id, k::BIGINT AS k, o_psi5::BIGINT AS o_psi5, o_psi3::BIGINT AS o_psi3, round(psi5, 9) AS psi5, round(psi3, 9) AS psi3 FROM m", METRICS_SQL)
def psi5_psi3(spark, sf_dir):
    return rounded(metrics.prime_sites(cohort(spark, sf_dir)).select("junction_id", "sample_id", "k", "o_psi5", "o_psi3", "psi5", "psi3"), "psi5", "psi3")


@query("SELECT site_id, sample_id, k::BIGINT AS k, o_theta::BIGINT AS o_theta, round(theta, 9) AS theta FROM th", METRICS_SQL)
def theta(spark, sf_dir):
    return rounded(metrics.site_theta(cohort(spark, sf_dir)).select("site_id", "sample_id", "k", "o_theta", "theta"), "theta")


@query("SELECT junction_id, sample_id, ns::BIGINT AS nonsplit FROM nonsplit", METRICS_SQL)
def intron_nonsplit_sum(spark, sf_dir):
    return metrics.nonsplit_sums(cohort(spark, sf_dir))


@query("SELECT junction_id, sample_id, k::BIGINT AS k, n_jaccard::BIGINT AS n, round(jaccard, 9) AS jaccard FROM m", METRICS_SQL)
def jaccard_index(spark, sf_dir):
    return rounded(jaccard_cells(spark, sf_dir).select("junction_id", "sample_id", "k", F.col("n_jaccard").alias("n"), "jaccard"), "jaccard")


@query("SELECT junction_id, sample_id, round(jaccard - median(jaccard) OVER (PARTITION BY junction_id), 9) AS delta FROM m", METRICS_SQL)
def delta_psi_median(spark, sf_dir):
    cells = metrics.delta_median(jaccard_cells(spark, sf_dir), "jaccard")
    return cells.select("junction_id", "sample_id", F.round("delta_median_jaccard", 9).alias("delta"))


@query("SELECT junction_id, max(k)::BIGINT AS max, round(avg(k), 9) AS mean, median(k) AS median, quantile_cont(k, 0.75) AS q75, round(stddev_samp(k), 9) AS sd, sum(k)::BIGINT AS sum FROM grid GROUP BY 1")
def row_statistics(spark, sf_dir):
    return rounded(metrics.row_stats(cohort(spark, sf_dir).grid(), "k"), "mean", "sd").withColumn("median", F.col("median").cast("double"))


@query("SELECT junction_id, CASE WHEN strand = '-' THEN end_id ELSE start_id END AS psi5, CASE WHEN strand = '-' THEN start_id ELSE end_id END AS psi3 FROM junctions")
def site_indices(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    five, three = (metrics.site_index(ds, m).withColumnRenamed("index", m) for m in ("psi5", "psi3"))
    return five.join(three, "junction_id")


@query("SELECT start_id, sample_id, arg_max(d, (abs(d), -junction_id)) AS d, arg_min(k, junction_id)::BIGINT AS first_k FROM (SELECT junction_id, start_id, sample_id, k, round(jaccard - avg(jaccard) OVER (PARTITION BY junction_id), 9) AS d FROM m) WHERE d IS NOT NULL GROUP BY ALL", METRICS_SQL)
def extreme_by_group(spark, sf_dir):
    cells = jaccard_cells(spark, sf_dir).withColumn("d", F.round(F.col("jaccard") - F.avg("jaccard").over(Window.partitionBy("junction_id")), 9)).filter("d is not null")
    keys = ["start_id", "sample_id"]
    return metrics.abs_max_by_group(cells, keys, "d", "junction_id").join(metrics.first_by_group(cells.select(*keys, "junction_id", F.col("k").alias("first_k")), keys, ["junction_id"]).drop("junction_id"), keys)


@query("SELECT junction_id, max(k)::BIGINT AS max_count, quantile_cont(n_jaccard::DOUBLE, 0.75) AS q_jaccard, max(k) >= 5 AND quantile_cont(n_jaccard::DOUBLE, 0.75) >= 10 AS passed_expression FROM m GROUP BY 1", METRICS_SQL)
def filter_expression(spark, sf_dir):
    return filters.expression(jaccard_cells(spark, sf_dir), 5)


@query("SELECT junction_id, max(k)::BIGINT AS max_count, quantile_cont((k + o_psi5)::DOUBLE, 0.75) AS q_psi5, quantile_cont((k + o_psi3)::DOUBLE, 0.75) AS q_psi3, max(k) >= 5 AND quantile_cont((k + o_psi5)::DOUBLE, 0.75) >= 10 AND quantile_cont((k + o_psi3)::DOUBLE, 0.75) >= 10 AS passed_expression FROM m GROUP BY 1", METRICS_SQL)
def filter_expression_by_site(spark, sf_dir):
    return filters.expression(jaccard_cells(spark, sf_dir), 5, jaccard=False)


DEV = "greatest(coalesce(max(abs(%s - mean)), 0), 0) AS %s FROM (SELECT *, avg(%s) OVER (PARTITION BY %s) AS mean FROM %s) GROUP BY 1"


@query(f"SELECT junction_id, round(d, 9) AS max_d_jaccard, round(d, 9) >= 0.02 AS passed_variability FROM (SELECT junction_id, {DEV % ('jaccard', 'd', 'jaccard', 'junction_id', 'm')})", METRICS_SQL)
def filter_variability(spark, sf_dir):
    return filters.variability(jaccard_cells(spark, sf_dir), 0.02)


@query(
    f"""SELECT j.junction_id, round(d5, 9) AS max_d_psi5, round(d3, 9) AS max_d_psi3, round(s.dt, 9) AS max_d_theta_start, round(e.dt, 9) AS max_d_theta_end, greatest(round(d5, 9), round(d3, 9), round(s.dt, 9), round(e.dt, 9)) >= 0.3 AS passed_variability
FROM junctions j JOIN (SELECT junction_id, {DEV % ('psi5', 'd5', 'psi5', 'junction_id', 'm')}) USING (junction_id) JOIN (SELECT junction_id, {DEV % ('psi3', 'd3', 'psi3', 'junction_id', 'm')}) USING (junction_id)
LEFT JOIN (SELECT site_id, {DEV % ('theta', 'dt', 'theta', 'site_id', 'th')}) s ON s.site_id = start_id LEFT JOIN (SELECT site_id, {DEV % ('theta', 'dt', 'theta', 'site_id', 'th')}) e ON e.site_id = end_id""",
    METRICS_SQL,
)
def filter_variability_by_site(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    return filters.variability_by_site(ds, metrics.prime_sites(ds), metrics.site_theta(ds), 0.3)


@query(f"SELECT junction_id, max_k >= 5 AND q >= 10 AND round(d, 9) >= 0.02 AS passed FROM (SELECT junction_id, {DEV % ('jaccard', 'd', 'jaccard', 'junction_id', 'm')}) JOIN (SELECT junction_id, max(k) AS max_k, quantile_cont(n_jaccard::DOUBLE, 0.75) AS q FROM m GROUP BY 1) USING (junction_id)", METRICS_SQL)
def filter_expression_and_variability(spark, sf_dir):
    return filters.expression_and_variability(jaccard_cells(spark, sf_dir), 5, min_delta=0.02).select("junction_id", "passed")


@query("SELECT junction_id FROM m GROUP BY 1 HAVING max(k) >= 5 AND quantile_cont(n_jaccard::DOUBLE, 0.75) < 300", METRICS_SQL)
def rare_junctions(spark, sf_dir):
    return filters.rare_junctions(filters.expression(jaccard_cells(spark, sf_dir), 5, min_quantile=300), 5).select("junction_id")


@query(f"SELECT junction_id, round(d, 9) >= 0.03 AS variable FROM (SELECT junction_id, {DEV % ('jaccard', 'd', 'jaccard', 'junction_id', 'm')})", METRICS_SQL)
def variable_junctions(spark, sf_dir):
    return filters.variable_junctions(jaccard_cells(spark, sf_dir), "jaccard", 0.03)


@query("SELECT junction_id, round(sd, 9) AS sd FROM (SELECT junction_id, stddev_samp(ln((k + 0.1) / (n_jaccard - k + 0.1))) AS sd FROM m GROUP BY 1) ORDER BY round(sd, 9) DESC NULLS LAST, junction_id LIMIT 50", METRICS_SQL)
def most_variable_junctions(spark, sf_dir):
    return rounded(filters.most_variable(jaccard_cells(spark, sf_dir), 50), "sd")


@query("SELECT junction_id, sample_id, k::BIGINT AS k FROM jc JOIN junctions USING (junction_id) WHERE seqname = 'chr1' AND start <= 6000 AND \"end\" >= 3000 AND sample_id < 10")
def subset_by_range(spark, sf_dir):
    from ..operators import intervals

    ds = cohort(spark, sf_dir)
    region = spark.createDataFrame([("chr1", 3000, 6000, "*")], "seqname string, start int, end int, strand string")
    kept = intervals.overlaps_any(ds.junctions, region, ["junction_id"], 5000)
    return ds.subset(junctions=kept, samples=ds.samples.filter("sample_id < 10")).j_counts


# --- tests, given mean and dispersion -----------------------------------------------------------

TEST_SQL = METRICS_SQL + """,
mu AS (SELECT junction_id, sum(k) / nullif(sum(n_jaccard), 0)::DOUBLE AS mu FROM m GROUP BY 1),
t AS (SELECT junction_id, sample_id, start_id, end_id, strand, seqname, start, "end", k, n_jaccard AS n, jaccard, nonsplit, mu, 0.02 + (junction_id % 7) * 0.01 AS rho FROM m JOIN mu USING (junction_id)),
ab AS (SELECT *, mu * (1 - rho) / rho AS a, (1 - mu) * (1 - rho) / rho AS b FROM t),
pm AS (SELECT junction_id, sample_id, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(i + a) + lgamma(n - i + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)) AS f FROM ab, unnest(generate_series(0::BIGINT, k::BIGINT)) AS u(i) WHERE mu > 0 AND mu < 1),
pc AS (SELECT junction_id, sample_id, sum(f) AS cdf, sum(f) FILTER (i = k) AS f FROM pm GROUP BY ALL),
pv AS (SELECT t.*, round(2 * least(least(cdf, 1), 1 - cdf + f, 0.5), 6) AS p FROM t LEFT JOIN pc USING (junction_id, sample_id)),
five AS (SELECT *, CASE WHEN strand = '-' THEN end_id ELSE start_id END AS index FROM pv),
fw AS (SELECT *, CASE WHEN count(p) OVER w > 0 THEN least(1.0, count(p) OVER w * min(p) OVER w) END AS p_site FROM five WINDOW w AS (PARTITION BY sample_id, index)),
gene AS (SELECT junction_id, 'g' || (start_id % 8) AS gene FROM junctions UNION SELECT junction_id, 'h' || (end_id % 5) FROM junctions)"""


def padj_sql(method: str, source: str, p: str, family: str, ids: str, name: str = "padj") -> str:
    """SQL of the adjusted p-values of a table."""
    term = {"BH": f"{p} * m_ / rn_", "BY": f"{p} * m_ / rn_ * list_sum(list_transform(range(1, greatest(m_, 1) + 1), lambda x: 1.0::DOUBLE / x))", "holm": f"{p} * (m_ - rn_ + 1)", "hochberg": f"{p} * (m_ - rn_ + 1)", "bonferroni": f"{p} * m_", "none": p}[method]
    over = {"BH": "min(x_) OVER (PARTITION BY {f}, {p} IS NULL ORDER BY rn_ DESC ROWS UNBOUNDED PRECEDING)", "holm": "max(x_) OVER (PARTITION BY {f}, {p} IS NULL ORDER BY rn_ ROWS UNBOUNDED PRECEDING)", "bonferroni": "x_"}[{"BY": "BH", "hochberg": "BH", "none": "bonferroni"}.get(method, method)].format(f=family, p=p)
    return f"SELECT * EXCLUDE (rn_, m_, x_), CASE WHEN {p} IS NOT NULL THEN least(1.0, {over}) END AS {name} FROM (SELECT *, {term} AS x_ FROM (SELECT *, row_number() OVER (PARTITION BY {family}, {p} IS NULL ORDER BY {p}, {ids}) AS rn_, count({p}) OVER (PARTITION BY {family}, {p} IS NULL) AS m_ FROM {source}))"


def tested(spark, sf_dir):
    """Cells with the row mean as mu, a dispersion by row and the beta-binomial p-value; written once for an application."""
    return once(spark, sf_dir, "tested-cells", _tested)


def _tested(spark, sf_dir):
    row = Window.partitionBy("junction_id")
    cells = jaccard_cells(spark, sf_dir).withColumn("mu", metrics.ratio(F.sum("k").over(row), F.sum("n_jaccard").over(row)))
    cells = cells.withColumn("rho", F.lit(0.02) + F.col("junction_id") % 7 * 0.01).withColumnRenamed("n_jaccard", "n")
    inside = (F.col("mu") > 0) & (F.col("mu") < 1)
    return cells.withColumn("p", F.round(F.when(inside, bb.bb_p_value("k", "n", "mu", "rho")), 6))


def five_prime(spark, sf_dir):
    return tested(spark, sf_dir).withColumn("index", F.when(F.col("strand") == "-", F.col("end_id")).otherwise(F.col("start_id")))


def genes_of(ds):
    named = ds.junctions.select("junction_id", F.explode(F.array(F.concat(F.lit("g"), F.col("start_id") % 8), F.concat(F.lit("h"), F.col("end_id") % 5))).alias("gene"))
    return named.distinct()


@query("SELECT junction_id, sample_id, p FROM pv", TEST_SQL)
def beta_binomial_p_values(spark, sf_dir):
    return tested(spark, sf_dir).select("junction_id", "sample_id", "p")


@query(
    """SELECT junction_id, sample_id, round(2 * least(least(c, 1), 1 - c + f, 0.5), 6) AS p FROM t LEFT JOIN (SELECT junction_id, sample_id, sum(f) AS c, sum(f) FILTER (i = k) AS f FROM
(SELECT junction_id, sample_id, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mu) + (n - i) * ln(1 - mu)) AS f FROM t, unnest(generate_series(0::BIGINT, k::BIGINT)) AS u(i) WHERE mu > 0 AND mu < 1) GROUP BY ALL) USING (junction_id, sample_id)""",
    TEST_SQL,
)
def binomial_p_values(spark, sf_dir):
    cells = tested(spark, sf_dir)
    return cells.select("junction_id", "sample_id", F.round(F.when((F.col("mu") > 0) & (F.col("mu") < 1), bb.binomial_p_value("k", "n", "mu")), 6).alias("p"))


ZSQL = "SELECT junction_id, sample_id, round((r - avg(r) OVER (PARTITION BY junction_id)) / nullif(stddev_samp(r) OVER (PARTITION BY junction_id), 0), 7) AS z FROM (SELECT *, ln((k + 0.1) / (n - k + 0.1)) - ln(mu / (1 - mu)) AS r FROM t WHERE mu > 0 AND mu < 1)"


@query(ZSQL, TEST_SQL)
def z_scores(spark, sf_dir):
    cells = tested(spark, sf_dir).filter("mu > 0 and mu < 1")
    return cells.select("junction_id", "sample_id", F.round(metrics.z_score("k", "n", "mu"), 7).alias("z"))


@query(
    "SELECT junction_id, sample_id, round(CASE WHEN abs(r) > 1.345 THEN 1.345 / abs(r) ELSE CASE WHEN r IS NULL THEN 0 ELSE 1 END END, 9) AS w FROM (SELECT junction_id, sample_id, (k - n * mu) / nullif(sqrt(n * mu * (1 - mu) * (1 + (n - 1) * rho)), 0) AS r FROM t)",
    TEST_SQL,
)
def huber_weights(spark, sf_dir):
    return tested(spark, sf_dir).select("junction_id", "sample_id", F.round(metrics.huber_weight("k", "n", "mu", "rho"), 9).alias("w"))


def _adjust(method: str):
    def run(spark, sf_dir):
        return rounded(padjust.adjusted(tested(spark, sf_dir).select("junction_id", "sample_id", "p"), "p", ["sample_id"], ["junction_id"], method), "padj")

    run.__name__ = f"p_adjust_{method.lower()}"
    query(f"SELECT junction_id, sample_id, p, round(padj, 9) AS padj FROM ({padj_sql(method, '(SELECT junction_id, sample_id, p FROM pv)', 'p', 'sample_id', 'junction_id')})", TEST_SQL)(run)


for _m in padjust.METHODS[:-1]:
    _adjust(_m)


#: The definition itself: the largest Simes p-value of a set that has the hypothesis; of sets of one size the one with the largest other p-values counts.
HOMMEL_SQL = """, hs AS (SELECT junction_id, sample_id, p, row_number() OVER (PARTITION BY sample_id ORDER BY p, junction_id) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM pv WHERE p IS NOT NULL),
si AS (SELECT a.sample_id, a.n - a.i + 1 AS m, min((a.n - a.i + 1) * b.p / (b.i - a.i + 1)) AS c, min((a.n - a.i + 1) * b.p / (b.i - a.i + 1)) FILTER (b.i > a.i) AS q FROM hs a JOIN hs b ON a.sample_id = b.sample_id AND b.i >= a.i GROUP BY ALL),
ho AS (SELECT hs.junction_id, hs.sample_id, hs.p, greatest(hs.p, max(CASE WHEN si.m > hs.n - hs.i + 1 THEN si.c ELSE least(si.m * hs.p, coalesce(si.q, si.m * hs.p)) END)) AS padj FROM hs JOIN si ON hs.sample_id = si.sample_id GROUP BY hs.junction_id, hs.sample_id, hs.p)"""


@query("SELECT pv.junction_id, pv.sample_id, pv.p, round(least(padj, 1.0), 9) AS padj FROM pv LEFT JOIN ho USING (junction_id, sample_id)", TEST_SQL + HOMMEL_SQL)
def p_adjust_hommel(spark, sf_dir):
    return rounded(padjust.adjusted(tested(spark, sf_dir).select("junction_id", "sample_id", "p"), "p", ["sample_id"], ["junction_id"], "hommel"), "padj")


@query("SELECT junction_id, sample_id, round(p_site, 9) AS p_site FROM (SELECT *, CASE WHEN count(q) OVER w > 0 THEN least(1.0, count(q) OVER w * min(q) OVER w) END AS p_site FROM (SELECT *, CASE WHEN rho <= 0.06 THEN p END AS q FROM five) WINDOW w AS (PARTITION BY sample_id, index)) f".replace("p_site FROM (SELECT *, CASE WHEN count", "p_site FROM (SELECT * EXCLUDE (p), CASE WHEN count"), TEST_SQL)
def family_wise_p_values(spark, sf_dir):
    cells = five_prime(spark, sf_dir).withColumn("p_site", padjust.least_holm("p", ["sample_id", "index"], F.col("rho") <= 0.06))
    return rounded(cells.select("junction_id", "sample_id", "p_site"), "p_site")


ONE = "(SELECT sample_id, index, min(p_site) AS p_site FROM fw GROUP BY ALL)"
SITE_PADJ = TEST_SQL + f", sp AS ({padj_sql('BY', ONE, 'p_site', 'sample_id', 'index')}), res AS (SELECT fw.*, sp.padj FROM fw JOIN sp ON sp.sample_id = fw.sample_id AND sp.index = fw.index)"


def site_tests(spark, sf_dir):
    return padjust.fdr_per_sample(five_prime(spark, sf_dir))


@query("SELECT junction_id, sample_id, round(p_site, 9) AS p_site, round(padj, 9) AS padj FROM res", SITE_PADJ)
def site_fdr(spark, sf_dir):
    return rounded(site_tests(spark, sf_dir).select("junction_id", "sample_id", "p_site", "padj"), "p_site", "padj")


GENE_P = "(SELECT gene, sample_id, CASE WHEN count(p) > 0 THEN least(1.0, count(p) * min(p)) END AS p_gene FROM (SELECT gene, sample_id, index, min(p) AS p FROM five JOIN gene USING (junction_id) GROUP BY ALL) GROUP BY ALL)"
GENE_SQL = SITE_PADJ + f", gp AS ({padj_sql('BY', GENE_P, 'p_gene', 'sample_id', 'gene', 'padj_gene')})"


@query("SELECT gene, sample_id, round(p_gene, 9) AS p_gene, round(padj_gene, 9) AS padj_gene FROM gp", GENE_SQL)
def gene_level_p_values(spark, sf_dir):
    out = padjust.gene_p_values(five_prime(spark, sf_dir), genes_of(cohort(spark, sf_dir)))
    return rounded(out, "p_gene", "padj_gene")


SUBSET = "(SELECT DISTINCT sample_id, index, p_site FROM fw WHERE index % 3 = sample_id % 3)"
SUBSET_PADJ = padj_sql("BY", SUBSET, "p_site", "sample_id", "index", "padj_subset")


@query(f"SELECT sample_id, index, round(padj_subset, 9) AS padj_subset FROM ({SUBSET_PADJ})", SITE_PADJ)
def subset_fdr(spark, sf_dir):
    cells = site_tests(spark, sf_dir)
    subset = cells.filter("index % 3 = sample_id % 3").select(F.lit("thirds").alias("subset"), "sample_id", "index")
    return rounded(padjust.fdr_on_subset(cells, subset).select("sample_id", "index", "padj_subset"), "padj_subset")
