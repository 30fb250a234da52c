"""The data behind plots, as tables; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import beta
from .results import aberrant


def log_p(column: str):
    return F.abs(F.log10(F.greatest(F.col(column), F.lit(1e-300))))


def plotting_table(cells: DataFrame, metric: str, padj_cutoff: float | None = 0.1, delta_cutoff: float | None = 0.1, min_count: int | None = 5) -> DataFrame:
    """A row for each tested cell: k, n, p, padj, observed and predicted ratio, rho, delta and whether it is aberrant."""
    out = cells.withColumn("delta", F.col("psi") - F.col("mu"))
    call = aberrant(F.col("padj"), F.col("delta"), F.col("n"), None, padj_cutoff, delta_cutoff, min_count)
    return out.withColumn("aberrant", call).select("junction_id", "sample_id", F.lit(metric).alias("type"), "k", "n", "p", "padj", F.col("psi").alias("observed"), F.col("mu").alias("predicted"), "rho", "delta", "aberrant")


def gene_table(table: DataFrame, genes: DataFrame, gene_p: DataFrame) -> DataFrame:
    """The best row of each gene and sample, with the gene's p-values in place of the junction's."""
    order = Window.partitionBy("gene", "sample_id").orderBy(F.asc_nulls_last("p"), F.desc(F.abs("delta")), "junction_id")
    best = table.join(genes, "junction_id").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "p", "padj")
    return best.join(gene_p.select("gene", "sample_id", F.col("p_gene").alias("p"), F.col("padj_gene").alias("padj")), ["gene", "sample_id"])


def volcano(table: DataFrame) -> DataFrame:
    """Effect and significance of each cell, and its class."""
    kind = F.when(F.col("aberrant"), "aberrant").when(F.col("p").isNull(), "not tested").otherwise("other")
    return table.select("junction_id", "sample_id", "delta", log_p("p").alias("log_p"), kind.alias("class"))


def expression(table: DataFrame) -> DataFrame:
    """Counts of each cell as they stand on logarithmic axes."""
    return table.select("junction_id", "sample_id", (F.col("k") + 1).alias("k_plus_1"), (F.col("n") + 2).alias("n_plus_2"), "aberrant")


def expected_observed(table: DataFrame) -> DataFrame:
    return table.filter("observed is not null and predicted is not null").select("junction_id", "sample_id", "predicted", "observed", "aberrant")


def aberrant_per_sample(table: DataFrame) -> DataFrame:
    """Samples that were tested, by their number of outliers, with rank and the median over samples."""
    counted = table.groupBy("sample_id").agg(F.count_if("aberrant").alias("n_aberrant"), F.count("p").alias("tested")).filter("tested > 0")
    # one row for each sample
    every = Window.partitionBy(F.lit(1))
    return counted.withColumns({"rank": F.row_number().over(every.orderBy("n_aberrant", "sample_id")), "median": F.median("n_aberrant").over(every)}).drop("tested")


def variability_histogram(judged: DataFrame, bins: int = 100, top: float = 1.0, value: str = "max_d_jaccard") -> DataFrame:
    """Junctions by their largest deviation, those that passed and those that did not."""
    return judged.groupBy(F.width_bucket(F.round(value, 9), F.lit(0.0), F.lit(top), F.lit(bins)).alias("bin"), F.col("passed_variability").alias("passed")).agg(F.count(F.lit(1)).alias("n"))


def thinned(points: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Of the points of a QQ plot one for each place on a grid of so many digits, the one of the least rank."""
    rest = [c for c in points.columns if c not in by]
    place = [F.bround("expected", digits).alias("_x"), F.bround("observed", digits).alias("_y")]
    return points.groupBy(*by, *place).agg(F.min_by(F.struct(*rest), "rank").alias("p")).select(*by, "p.*")


def ribbon(points: DataFrame, by: list[str], alpha: float = 0.05, digits: int | None = 3) -> DataFrame:
    """Points of a QQ plot (results.qq), thinned to ``digits`` (None: all), with the band in which 1 - alpha of such ranks lie if no hypothesis is false: lower and upper, as -log10.

    The p-value of rank i of n has a beta distribution; its shapes are i and n - i here, so the last point has no width.
    """
    kept = points if digits is None else thinned(points, by, digits)
    bound = lambda p: F.abs(F.log10(F.greatest(beta.quantile(F.lit(p), F.col("rank"), F.col("n") - F.col("rank")), F.lit(1e-300))))
    return kept.withColumns({"lower": bound(1 - alpha / 2), "upper": bound(alpha / 2)})


def search_data(runs: DataFrame, score: str = "auc") -> DataFrame:
    """Hyper-parameters tried (q, noise, a score), each with whether it is the best: the highest score, the smallest q on ties."""
    best = Window.partitionBy("type").orderBy(F.desc_nulls_last(score), "q", "noise")
    return runs.withColumn("best", F.row_number().over(best) == 1)
