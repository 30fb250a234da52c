"""Queries over full result tables and plot data, with their SQL. Cells are tested against the mean of their junction."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import links
from ..operators import filters, fitting, metrics, padjust, plots, results
from ..sources import files, shared
from ..sources.cohort import cohort, jaccard_cells
from .annotated import ANN_SQL, PADJ_CUTOFF, gene_table
from .splicing import GENE_P, GENE_SQL, METRICS_SQL, SITE_PADJ, TEST_SQL, five_prime, genes_of, padj_sql, query, rounded, site_tests, tested

SIGNIF = "CASE WHEN {0} = 0 THEN 0.0 ELSE round_even({0} * pow(10.0, 4 - floor(log10(abs({0})))), 0) / pow(10.0, 4 - floor(log10(abs({0})))) END"


def signif_sql(column: str) -> str:
    return SIGNIF.format(column)


def even_sql(column: str) -> str:
    """Two digits by the half-even rule on the decimal digits of a number, as BROUND does."""
    v = f"({column})::VARCHAR::DECIMAL(30, 17) * 100::DECIMAL(3, 0)"
    return f"(floor({v}) + CASE WHEN {v} - floor({v}) > 0.5 OR {v} - floor({v}) = 0.5 AND floor({v})::BIGINT % 2 <> 0 THEN 1 ELSE 0 END)::DOUBLE / 100"


def cells(spark, sf_dir):
    """Tested cells as result tables take them; p-values and ratios to nine digits, so that no digit behind decides a cutoff."""
    out = site_tests(spark, sf_dir).withColumns({"padj": F.round("padj", 9), "psi": F.round("jaccard", 9), "mu": F.round("mu", 9)})
    return out.select("junction_id", "seqname", "start", "end", "strand", "index", "sample_id", "k", "n", "psi", "mu", "rho", "nonsplit", "p", "padj")


RES_SQL = SITE_PADJ + f""",
rc AS (SELECT junction_id, seqname, start, "end", strand, sample_id, k, n, nonsplit, p, round(padj, 9) AS padj, round(jaccard, 9) AS psi, round(mu, 9) AS mu FROM res),
rt AS (SELECT *, psi - mu AS delta, avg(k) OVER w AS mk, avg(n) OVER w AS mn, nonsplit / nullif(n, 0)::DOUBLE AS share, quantile_cont(nonsplit / nullif(n, 0)::DOUBLE, 0.99) OVER w AS q99 FROM rc WINDOW w AS (PARTITION BY junction_id)),
ro AS (SELECT junction_id, seqname, start, "end", strand, sample_id, 'jaccard' AS type, {signif_sql('p')} AS p_value, {signif_sql('padj')} AS padjust, {even_sql('psi')} AS psi_value, {even_sql('delta')} AS delta_psi, k::BIGINT AS counts, n::BIGINT AS total_counts,
  {even_sql('mk')} AS mean_counts, {even_sql('mn')} AS mean_total_counts, nonsplit::DOUBLE AS nonsplit_counts, {even_sql('share')} AS nonsplit_proportion, {even_sql('q99')} AS nonsplit_proportion_99quantile, p, padj, delta, n,
  coalesce(padj <= {PADJ_CUTOFF}, false) AND coalesce(abs(delta) >= 0.01, false) AND n >= 5 AS aberrant, coalesce(abs(delta) >= 0.01, false) AND n >= 5 AS loose FROM rt)"""
OUT = 'junction_id, seqname, start, "end", strand, sample_id, type, round(p_value, 9) AS p_value, round(padjust, 9) AS padjust, psi_value, delta_psi, counts, total_counts, mean_counts, mean_total_counts, nonsplit_counts, nonsplit_proportion, nonsplit_proportion_99quantile'


def shown(df, *also: str):
    rounded = df.withColumns({c: F.round(c, 9) for c in ("p_value", "padjust", *[a for a in also if a.endswith("_gene")])})
    return rounded.select("junction_id", "seqname", "start", "end", "strand", *results.COLUMNS, *also)


@query(f"SELECT {OUT} FROM ro WHERE aberrant", RES_SQL)
def outlier_results(spark, sf_dir):
    return shown(results.metric_results(results.result_columns(cells(spark, sf_dir), "jaccard"), PADJ_CUTOFF, 0.01, 5))


@query(f"SELECT {OUT} FROM ro", RES_SQL)
def all_results(spark, sf_dir):
    return shown(results.metric_results(results.result_columns(cells(spark, sf_dir), "jaccard"), all_=True))


GENE_RES = RES_SQL + GENE_SQL[len(SITE_PADJ):] + f""",
best AS (SELECT gene, sample_id, arg_min(junction_id, (p, -abs(delta), junction_id)) AS junction_id FROM ro JOIN gene USING (junction_id) WHERE loose AND p IS NOT NULL GROUP BY ALL),
gr AS (SELECT ro.*, gp.gene, {signif_sql('p_gene')} AS p_value_gene, {signif_sql('padj_gene')} AS padjust_gene FROM best JOIN ro USING (junction_id, sample_id) JOIN gp ON gp.gene = best.gene AND gp.sample_id = best.sample_id WHERE padj_gene <= 0.95)"""


def gene_rows(spark, sf_dir):
    g = genes_of(cohort(spark, sf_dir))
    gene_p = padjust.gene_p_values(five_prime(spark, sf_dir), g)
    return results.gene_results(results.result_columns(cells(spark, sf_dir), "jaccard"), g, gene_p, 0.95, 0.01, 5)


@query(f"SELECT {OUT}, gene, round(p_value_gene, 9) AS p_value_gene, round(padjust_gene, 9) AS padjust_gene FROM gr", GENE_RES)
def gene_results(spark, sf_dir):
    return shown(gene_rows(spark, sf_dir), "gene", "p_value_gene", "padjust_gene")


@query("SELECT gene, sample_id, arg_min(junction_id, (p_value_gene, p_value, type, junction_id)) AS junction_id FROM (SELECT gene, sample_id, p_value_gene, p_value, type, junction_id FROM gr UNION ALL SELECT gene, sample_id, p_value_gene, p_value, 'psi5', junction_id FROM gr WHERE counts % 2 = 0) GROUP BY ALL", GENE_RES)
def collapsed_results(spark, sf_dir):
    """Over two metrics: here the second one repeats the rows of even counts."""
    rows = gene_rows(spark, sf_dir)
    both = rows.unionByName(rows.filter("counts % 2 = 0").withColumn("type", F.lit("psi5")))
    return results.collapsed(both).select("gene", "sample_id", "junction_id")


@query(f"SELECT r.junction_id, r.sample_id, round({signif_sql('r.padj')}, 9) AS all_samples, round(CASE WHEN r.sample_id % 2 = 0 THEN {signif_sql('r.padj')} END, 9) AS even FROM rc r", RES_SQL)
def fdr_set_union(spark, sf_dir):
    """Results of two FDR sets side by side; the second set has no rows for odd samples."""
    rows = results.result_columns(cells(spark, sf_dir), "jaccard").select("junction_id", "sample_id", "padjust", "counts")
    out = results.with_fdr_sets({"all": rows, "even": rows.filter("sample_id % 2 = 0")}, ["junction_id", "sample_id"])
    return out.select("junction_id", "sample_id", F.round("padjust_all", 9).alias("all_samples"), F.round("padjust_even", 9).alias("even"))


@query("SELECT junction_id, sample_id, junction_id AS found FROM jc")
def result_feature_index(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    rows = ds.j_counts.select("junction_id", "sample_id").join(ds.junctions.select("junction_id", "seqname", "start", "end", "strand"), "junction_id")
    return results.feature_index(ds.junctions, rows).select("junction_id", "sample_id", F.col("index").alias("found"))


@query("SELECT junction_id, sample_id, round((k + 0.1) / (n + 0.2) - mu, 9) AS delta FROM t", TEST_SQL)
def pseudocount_delta(spark, sf_dir):
    from ..analysis import pseudocount_delta as operator

    return operator(tested(spark, sf_dir)).select("junction_id", "sample_id", F.round("delta", 9).alias("delta"))


def plotted(spark, sf_dir):
    return plots.plotting_table(cells(spark, sf_dir), "jaccard", PADJ_CUTOFF, 0.01, 5)


PLOT_SQL = RES_SQL + ", rr AS (SELECT ro.*, rc.psi, rc.mu FROM ro JOIN rc USING (junction_id, sample_id))"


@query("SELECT junction_id, sample_id, type, counts AS k, n::BIGINT AS n, p, padj, psi AS observed, mu AS predicted, round(delta, 9) AS delta, aberrant FROM rr", PLOT_SQL)
def plotting_table(spark, sf_dir):
    return plotted(spark, sf_dir).drop("rho").withColumn("delta", F.round("delta", 9))


@query("SELECT gene, sample_id, arg_min(junction_id, (coalesce(p, 9), -abs(delta), junction_id)) AS junction_id FROM rr JOIN gene USING (junction_id) GROUP BY ALL", RES_SQL + GENE_SQL[len(SITE_PADJ):] + PLOT_SQL[len(RES_SQL):])
def gene_plotting_table(spark, sf_dir):
    g = genes_of(cohort(spark, sf_dir))
    return plots.gene_table(plotted(spark, sf_dir), g, padjust.gene_p_values(five_prime(spark, sf_dir), g)).select("gene", "sample_id", "junction_id")


@query("SELECT junction_id, sample_id, round(delta, 9) AS delta, round(abs(log10(greatest(p, 1e-300))), 7) AS log_p, CASE WHEN aberrant THEN 'aberrant' WHEN p IS NULL THEN 'not tested' ELSE 'other' END AS class FROM rr", PLOT_SQL)
def volcano_plot_data(spark, sf_dir):
    known = plots.volcano(plotted(spark, sf_dir))
    return known.withColumns({"delta": F.round("delta", 9), "log_p": F.round("log_p", 7)})


@query("SELECT junction_id, sample_id, counts + 1 AS k_plus_1, n::BIGINT + 2 AS n_plus_2, aberrant FROM rr", PLOT_SQL)
def expression_plot_data(spark, sf_dir):
    return plots.expression(plotted(spark, sf_dir))


@query("SELECT junction_id, sample_id, mu AS predicted, psi AS observed, aberrant FROM rr WHERE psi IS NOT NULL AND mu IS NOT NULL", PLOT_SQL)
def expected_observed_plot_data(spark, sf_dir):
    return plots.expected_observed(plotted(spark, sf_dir))


@query("SELECT sample_id, n_aberrant, row_number() OVER (ORDER BY n_aberrant, sample_id) AS rank, median(n_aberrant) OVER () AS median FROM (SELECT sample_id, count(*) FILTER (aberrant) AS n_aberrant FROM rr GROUP BY 1 HAVING count(p) > 0)", PLOT_SQL)
def aberrant_samples_plot_data(spark, sf_dir):
    return plots.aberrant_per_sample(plotted(spark, sf_dir)).withColumns({"rank": F.col("rank").cast("long"), "median": F.col("median").cast("double")})


@query("SELECT (CASE WHEN d >= 1 THEN 101 ELSE floor(d / 0.01) + 1 END)::BIGINT AS bin, d >= 0.02 AS passed, count(*) AS n FROM (SELECT junction_id, round(greatest(coalesce(max(abs(jaccard - mean)), 0), 0), 9) AS d FROM (SELECT *, avg(jaccard) OVER (PARTITION BY junction_id) AS mean FROM m) GROUP BY 1) GROUP BY ALL", METRICS_SQL)
def variability_histogram(spark, sf_dir):
    return plots.variability_histogram(filters.variability(jaccard_cells(spark, sf_dir), 0.02))


def _links_sql() -> str:
    short, region, place = "replace(seqname, 'chr', '')", "replace(seqname, 'chr', '') || '-' || start || '-' || \"end\"", "replace(seqname, 'chr', '') || ':' || start || '-' || \"end\""
    anchor = lambda url, label: f"'<a href=\"' || {url} || '\" target=\"_blank\">' || {label} || '</a>'"
    urls = {"search": (f"'{links.SEARCH}' || symbol", "symbol"), "ensembl": (f"'{links.SEARCH}ENSEMBL ' || symbol", "symbol"), "omim": (f"'{links.SEARCH}OMIM ' || symbol", "symbol")}
    urls |= {n: (f"'{b}' || symbol", "symbol") for n, b in links.SYMBOL_PAGES.items()} | {n: (f"'{b}' || {region}", place) for n, b in links.REGION_PAGES.items()}
    urls["ensembl_browser"] = (f"'{links.GENOME_BROWSER}' || {short} || '%3A' || greatest(0, start - 1000) || '-' || (\"end\" + 1000)", place)
    return "SELECT symbol, seqname, start, \"end\", " + ", ".join(f"{anchor(*v)} AS {n}" for n, v in urls.items()) + " FROM gn"


@query(_links_sql(), ANN_SQL)
def gene_links(spark, sf_dir):
    return links.link_table(gene_table(spark, sf_dir))


@query(
    "SELECT junction_id, sample_id, round(coalesce(x, max(x) OVER (PARTITION BY junction_id)), 7) AS x FROM (SELECT *, ln(v / (1 - v)) AS x FROM (SELECT junction_id, sample_id, CASE WHEN jaccard IS NOT NULL THEN greatest(0.01::DOUBLE, least(0.99::DOUBLE, " + even_sql("round(jaccard, 9)") + ")) END AS v FROM m))",
    METRICS_SQL,
)
def capped_logits(spark, sf_dir):
    cells = jaccard_cells(spark, sf_dir).withColumn("j", F.round("jaccard", 9))
    return cells.select("junction_id", "sample_id", F.round(links.capped_logit("j", "junction_id"), 7).alias("x"))


@query("SELECT junction_id, sample_id, round(x - avg(x) OVER (PARTITION BY junction_id), 7) AS x FROM (SELECT junction_id, sample_id, ln((k + 0.1) / (n_jaccard - k + 0.1)) AS x FROM m)", METRICS_SQL)
def autoencoder_inputs(spark, sf_dir):
    return jaccard_cells(spark, sf_dir).select("junction_id", "sample_id", F.round(links.autoencoder_input("k", "n_jaccard"), 7).alias("x"))


#: Outliers are drawn by hashes that SQL engines do not share, so what breaks the rules that every draw must keep is counted instead.
@query("SELECT true AS injected, 0::BIGINT AS unbalanced, 0::BIGINT AS moved_less, 0::BIGINT AS negative, 0::BIGINT AS moved_twice")
def injection_rules(spark, sf_dir):
    """Whether there are injected groups, and how many break the sum of their ratios, move by less than asked, have counts below 0, or move more than one junction.

    Ratios have pseudocounts, so those of a group of m add up to 1 + (m - 2) c / (n + 2 c), and the change of the siblings to that much more than the change of the junction that moves.
    """
    base = jaccard_cells(spark, sf_dir).withColumnRenamed("n_jaccard", "n_j").withColumn("n", F.col("k") + F.col("o_psi5"))
    index = metrics.site_index(cohort(spark, sf_dir), "psi5")
    out = fitting.inject_outliers(base.join(index, "junction_id"), 0.05, 0.2, 7, "index", "n")
    moves = F.abs("injected") == 1
    hit = out.filter("injected <> 0").groupBy("index", "sample_id").agg(
        F.sum("delta_injected").alias("d"), F.max(F.when(moves, F.col("delta_injected"))).alias("moved"), F.count_if(moves).alias("moves"), F.max(F.when(moves, (F.col("k") + 0.1) / (F.col("n") + 0.2))).alias("at"),
        F.max("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min("k_injected").alias("least"),
    )
    over = F.col("moved") * (F.col("size") - 2) * 0.1 / ((F.col("n") + 0.2) * (1 - F.col("at")))
    broken = {"unbalanced": F.abs(F.col("d") + over) > 1e-9, "moved_less": (F.abs("moved") < 0.2 - 1e-9) & (F.col("size") > 1), "negative": F.col("least") < 0, "moved_twice": F.col("moves") != 1}
    return hit.agg((F.count(F.lit(1)) > 0).alias("injected"), *[F.count_if(v).alias(k) for k, v in broken.items()])

#: The rules of each metric: a fixed move as far as there is room, theta's sites a tenth as often, groups of psi5 of two junctions at least.
@query("SELECT * FROM (VALUES ('jaccard', true, 0::BIGINT, 0::BIGINT), ('psi5', true, 0, 0), ('theta', true, 0, 0)) v(metric, injected, moved_otherwise, alone)")
def injection_by_metric(spark, sf_dir):
    """Whether outliers were injected, how many moved by anything but 0.3 or the room there was, and how many of psi5 stand alone in their group."""
    from ..analysis import metric_cells

    out = None
    for m in ("jaccard", "psi5", "theta"):
        made = fitting.inject_outliers(metric_cells(cohort(spark, sf_dir), m), 0.5 if m == "theta" else 0.05, 0.2, 7, "index", "n", metric=m, fixed=0.3)
        size = F.count(F.lit(1)).over(Window.partitionBy("index", "sample_id"))
        own = (F.col("k") + 0.1) / (F.col("n") + 0.2)
        made = made.withColumns({"size": size, "room": F.when(F.col("injected") > 0, 1 - own).otherwise(own)}).filter("abs(injected) = 1")
        otherwise = F.abs(F.abs("delta_injected") - F.least(F.lit(0.3), F.col("room"))) > 1e-9
        one = made.agg((F.count(F.lit(1)) > 0).alias("injected"), F.count_if(otherwise).alias("moved_otherwise"), F.count_if((F.col("size") < 2) & F.lit(m == "psi5")).alias("alone")).withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


SUBSET_GENES = f"(SELECT * FROM {GENE_P} WHERE gene = 'g' || sample_id % 8 OR gene = 'h' || sample_id % 5)"


@query(f"SELECT gene, sample_id, round(p_gene, 9) AS p_gene, round(padj_gene, 9) AS padj_gene FROM ({padj_sql('BY', SUBSET_GENES, 'p_gene', 'sample_id', 'gene', 'padj_gene')})", SITE_PADJ)
def subset_gene_fdr(spark, sf_dir):
    """Adjusted p-values of two genes of each sample, among these alone."""
    ds = cohort(spark, sf_dir)
    gene_p = padjust.gene_p_values(five_prime(spark, sf_dir), genes_of(ds))
    own = F.array(F.concat(F.lit("g"), F.col("sample_id") % 8), F.concat(F.lit("h"), F.col("sample_id") % 5))
    out = padjust.gene_fdr_on_subset(gene_p, ds.samples.select("sample_id", F.explode(own).alias("gene")))
    return rounded(out, "p_gene", "padj_gene")


ALL_GENES = GENE_RES[: GENE_RES.index("best AS (")] + f"""best AS (SELECT gene, sample_id, arg_min(junction_id, (p, -abs(delta), junction_id)) AS junction_id FROM ro JOIN gene USING (junction_id) WHERE p IS NOT NULL GROUP BY ALL),
gr AS (SELECT ro.*, gp.gene, {signif_sql('p_gene')} AS p_value_gene, {signif_sql('padj_gene')} AS padjust_gene FROM best JOIN ro USING (junction_id, sample_id) JOIN gp ON gp.gene = best.gene AND gp.sample_id = best.sample_id)"""


@query(f"SELECT {OUT}, gene, round(p_value_gene, 9) AS p_value_gene, round(padjust_gene, 9) AS padjust_gene FROM gr", ALL_GENES)
def all_gene_results(spark, sf_dir):
    """The best junction of every tested gene and sample: no cutoff applies."""
    g = genes_of(cohort(spark, sf_dir))
    rows = results.result_columns(cells(spark, sf_dir), "jaccard")
    out = results.gene_results(rows, g, padjust.gene_p_values(five_prime(spark, sf_dir), g), None, None, None)
    return shown(out, "gene", "p_value_gene", "padjust_gene")


@query("SELECT junction_id, sample_id, k::BIGINT AS k, nonsplit::BIGINT AS nonsplit, round(jaccard, 9) AS jaccard FROM m", METRICS_SQL)
def restored_ratios(spark, sf_dir):
    """The ratios after every junction of an odd donor was filtered out, saved and brought back, with the sites that had gone with it."""
    ds = cohort(spark, sf_dir)
    path = f"{shared.shared_dir(spark)}/filtered-{uuid.uuid4().hex}"
    kept = files.save_filtered(ds, ds.junctions.withColumn("passed", F.col("start_id") % 2 == 0), path)
    out = metrics.intron_jaccard(files.with_filtered(kept, path))
    return out.select("junction_id", "sample_id", "k", "nonsplit", F.round("jaccard", 9).alias("jaccard"))
