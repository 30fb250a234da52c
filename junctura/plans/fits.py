"""Queries over fitted models; numpy decides them, so there is no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..analysis import analyse, encoder_subset, injected_search, metric_cells, result_table, suggested_dimension
from ..operators import annotation, autoencoder, clusters, encoder, fitting, metrics, plots, results
from ..sources import shared
from ..sources.cohort import cohort, table, jaccard_cells
from .annotated import reference_introns
from .splicing import genes_of, tested


def _rows(spark, sf_dir):
    return fitting.packed(jaccard_cells(spark, sf_dir))


def pca_fit(spark, sf_dir):
    return fitting.fit_pca(_rows(spark, sf_dir), 3).select("junction_id", F.round("rho", 6).alias("rho"), F.posexplode("mu").alias("sample", "mu")).withColumn("mu", F.round("mu", 6))


def pca_p_values(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return fitting.p_values(rows, fitting.fit_pca(rows, 3)).withColumn("p", F.round("p", 6))


def beta_binomial_fit(spark, sf_dir):
    return fitting.fit_beta_binomial(_rows(spark, sf_dir)).select("junction_id", F.round("mu", 6).alias("mu"), F.round("rho", 6).alias("rho"))


def injected_outliers(spark, sf_dir):
    cells = jaccard_cells(spark, sf_dir)
    return fitting.inject_outliers(cells, 0.01).filter("injected <> 0").select("junction_id", "sample_id", "k", "k_injected", "injected")


QUERIES = {f.__name__: f for f in (pca_fit, pca_p_values, beta_binomial_fit, injected_outliers)}


def junction_impact(spark, sf_dir):
    """Impact labels of the junctions and sites of all samples; an intron is known if its acceptor's nation is in Europe, each supplier is a gene that begins with an exon."""
    ds = cohort(spark, sf_dir)
    reference = shared.written(reference_introns(spark, sf_dir, ds), "introns")
    known, use = reference.select("seqname", "start", "end", "strand"), reference.select("seqname", "start", "end", "median_count")
    place = F.col("s_suppkey") * 290
    genes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("gene_id"), F.concat(F.lit("chr"), F.col("s_suppkey") % 3 + 1).alias("seqname"), place.alias("start"), (place + 1500).alias("end"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    exons = genes.select("seqname", "start", (F.col("start") + 120).alias("end"), "strand")
    cells = metrics.delta_median(jaccard_cells(spark, sf_dir), "jaccard").withColumn("nonsplit_proportion", metrics.ratio(F.col("nonsplit"), F.col("n_jaccard")))
    q99 = cells.groupBy("junction_id").agg(F.percentile("nonsplit_proportion", F.lit(0.99)).alias("nonsplit_q99"))
    cells = cells.join(q99, "junction_id").join(annotation.reference_overlap(ds.junctions, reference), "junction_id")
    rows = cells.select("junction_id", "sample_id", "seqname", "start", "end", "strand", F.round("delta_median_jaccard", 9).alias("delta"), "annotated", "nonsplit_proportion", "nonsplit_q99", F.col("nonsplit").alias("nonsplit_counts"))
    rows = shared.written(rows, "impact-rows")
    psi = annotation.impact(rows, use, exons, genes).drop("nonsplit_proportion", "nonsplit_q99", "nonsplit_counts").withColumn("type", F.lit("jaccard"))
    # a site's id can stand on several sequences
    sites = ds.site_grid().withColumns({"number": F.col("site_id"), "site_id": F.concat_ws(":", "seqname", "start", "end", "strand")})
    theta = annotation.theta_impact(sites.select("site_id", "number", "sample_id", "seqname", "start", "end", "strand"), known, exons, genes)
    return psi.unionByName(theta.drop("site_id").withColumnRenamed("number", "site_id").withColumn("type", F.lit("theta")), allowMissingColumns=True)


QUERIES["junction_impact"] = junction_impact


def analysis_results(spark, sf_dir):
    """Fit, tests, FDR and genes of the jaccard index and psi5 in one call, all cells of both."""
    ds = cohort(spark, sf_dir)
    done = analyse(ds, 3, ("jaccard", "psi5"), genes=genes_of(ds))
    return result_table(done, all_=True).withColumns({c: F.round(c, 6) for c in ("p_value", "padjust_transcriptome_wide")})


def theta_results(spark, sf_dir):
    return result_table(analyse(cohort(spark, sf_dir), 3, ("theta",)), all_=True).withColumn("p_value", F.round("p_value", 6))


def estimated_dimension(spark, sf_dir):
    """The number of components by optimal hard thresholding, beside the default for so many samples."""
    ds = cohort(spark, sf_dir)
    return spark.createDataFrame([(fitting.best_dimension(_rows(spark, sf_dir)), suggested_dimension(ds.samples.count()))], "q int, default_q int")


def autoencoder_fit(spark, sf_dir):
    found = autoencoder.fit_autoencoder(_rows(spark, sf_dir), 3, 2)
    return found.select("junction_id", F.round("rho", 4).alias("rho"), F.round("loss", 4).alias("loss"))


def encoder_fit(spark, sf_dir):
    """An autoencoder with weights for the most variable junctions, corrupted inputs and Huber weights: the fit of all junctions."""
    cells = metric_cells(cohort(spark, sf_dir), "jaccard")
    found = encoder.fit_encoded(fitting.packed(cells, "k", "n"), 3, 2, encoder_subset(cells, 200, 0.02), weighted=True, noise=0.2)
    return found.fit.select("junction_id", F.round("rho", 4).alias("rho"), F.round("loss", 4).alias("loss"))


def qq_ribbon(spark, sf_dir):
    """Points of the QQ plots of all samples, thinned, with the band of expected ranks."""
    p = tested(spark, sf_dir).select("junction_id", "sample_id", "p")
    out = plots.ribbon(results.qq(p, ["sample_id"]), ["sample_id"], 0.05, 1)
    return out.select("sample_id", "rank", *[F.round(c, 6).alias(c) for c in ("expected", "observed", "lower", "upper")])


def correlation_heatmap(spark, sf_dir):
    """Correlations of the samples' centred logit ratios, in the order of their clustering."""
    cells = metric_cells(cohort(spark, sf_dir), "jaccard")
    return clusters.ordered_correlation(cells, 5, min_median=0, min_count=2, logit=True).withColumn("spearman", F.round("spearman", 6))


def dimension_search(spark, sf_dir):
    """Areas under the precision-recall curve for some numbers of components and shares of noise, by outliers injected into the cohort."""
    cells = metric_cells(cohort(spark, sf_dir), "jaccard")
    return plots.search_data(injected_search(cells, [2, 4], freq=0.01, noise=(0.0, 0.5, 1.0)).withColumns({"auc": F.round("auc", 4), "type": F.lit("jaccard")}))


QUERIES |= {f.__name__: f for f in (analysis_results, theta_results, estimated_dimension, autoencoder_fit, encoder_fit, qq_ribbon, correlation_heatmap, dimension_search)}
