"""Outlier calls, result tables and the data behind plots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import draw


def aberrant(padj: Column, delta: Column, n: Column, rho: Column | None = None, padj_cutoff: float | None = 0.1, delta_cutoff: float | None = 0.1, min_count: int | None = 5, rho_cutoff: float | None = None) -> Column:
    """True where all cutoffs that are given hold; NULL counts as not."""
    out = F.lit(True)
    for cond, cut in ((padj, padj_cutoff), (delta, delta_cutoff), (n, min_count), (rho, rho_cutoff)):
        if cut is not None and cond is not None:
            out &= F.coalesce(F.abs(cond) >= cut if cond is delta else cond >= cut if cond is n else cond <= cut, F.lit(False))
    return out


def counts(calls: DataFrame, by: str, flag: str = "aberrant") -> DataFrame:
    return calls.groupBy(by).agg(F.count_if(flag).alias("n_aberrant"))


def gene_calls(calls: DataFrame, genes: DataFrame, gene_padj: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """gene, sample_id, aberrant: any junction of the gene passes without its own padj, and the gene's padj passes."""
    hit = calls.join(genes, "junction_id").groupBy("gene", "sample_id").agg(F.bool_or("loose").alias("loose"))
    return hit.join(gene_padj.select("gene", "sample_id", "padj_gene"), ["gene", "sample_id"]).select("gene", "sample_id", (F.col("loose") & F.coalesce(F.col("padj_gene") <= cutoff, F.lit(False))).alias("aberrant"))


def signif(column: str, digits: int = 5) -> Column:
    """A number to so many significant digits; 0 and NULL stay."""
    v = F.col(column)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v * scale) / scale)


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy("p_value", F.desc(F.abs("delta")), "junction_id", "sample_id")


#: What a result row tells of a cell, besides its feature.
COLUMNS = ["sample_id", "type", "p_value", "padjust", "psi_value", "delta_psi", "counts", "total_counts", "mean_counts", "mean_total_counts", "nonsplit_counts", "nonsplit_proportion", "nonsplit_proportion_99quantile"]


def result_columns(cells: DataFrame, metric: str, feature: str = "junction_id", also: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a result table for every tested cell of a metric.

    ``cells``: the feature with its range, sample_id, k, n, psi, mu, p, padj, and nonsplit for the jaccard index. Means and quantiles are those of the
    feature over all samples, so they are taken before anything is filtered.
    """
    row = Window.partitionBy(feature)
    share = F.col("nonsplit") / F.nullif(F.col("n"), F.lit(0)) if metric == "jaccard" else F.lit(None).cast("double")
    out = cells.withColumns({"_share": share, "_k": F.avg("k").over(row), "_n": F.avg("n").over(row), "_delta": F.col("psi") - F.col("mu")})
    q99 = F.percentile("_share", F.lit(0.99)).over(row) if metric == "jaccard" else F.lit(None).cast("double")
    nonsplit = F.col("nonsplit").cast("double") if metric == "jaccard" else F.lit(None).cast("double")
    out = out.withColumns({
        "type": F.lit(metric), "p_value": signif("p"), "padjust": signif("padj"), "psi_value": F.bround("psi", 2), "delta_psi": F.bround("_delta", 2), "counts": F.col("k"), "total_counts": F.col("n"),
        "mean_counts": F.bround("_k", 2), "mean_total_counts": F.bround("_n", 2), "nonsplit_counts": nonsplit, "nonsplit_proportion": F.bround("_share", 2), "nonsplit_proportion_99quantile": F.bround(q99, 2),
    })
    return out.withColumnRenamed("_delta", "delta").select(feature, "seqname", "start", "end", "strand", *COLUMNS, "p", "padj", "delta", "n", *also)


def metric_results(table: DataFrame, padj_cutoff: float | None = 0.1, delta_cutoff: float | None = 0.1, min_count: int | None = 5, all_: bool = False) -> DataFrame:
    """The rows of ``result_columns`` that are aberrant, or all."""
    call = aberrant(F.col("padj"), F.col("delta"), F.col("n"), None, padj_cutoff, delta_cutoff, min_count)
    return table if all_ else table.filter(call)


def gene_results(table: DataFrame, genes: DataFrame, gene_padj: DataFrame, padj_cutoff: float | None = 0.1, delta_cutoff: float | None = 0.1, min_count: int | None = 5, feature: str = "junction_id") -> DataFrame:
    """The best junction of each aberrant gene and sample, with the gene's p-values; a junction of several such genes has a row for each.

    A junction counts by its own effect and coverage, whatever its own FDR; the gene must pass the FDR. A cutoff of None does not apply.
    """
    loose = aberrant(F.col("padj"), F.col("delta"), F.col("n"), None, None, delta_cutoff, min_count)
    rows = table.filter(loose & F.col("p").isNotNull()).join(genes.select(feature, "gene"), feature).join(gene_padj if padj_cutoff is None else gene_padj.filter(F.col("padj_gene") <= padj_cutoff), ["gene", "sample_id"])
    best = Window.partitionBy("gene", "sample_id").orderBy("p", F.desc(F.abs("delta")), feature)
    out = rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    return out.withColumns({"p_value_gene": signif("p_gene"), "padjust_gene": signif("padj_gene")}).drop("p_gene", "padj_gene")


def collapsed(results: DataFrame, gene: str = "gene") -> DataFrame:
    """One row for each gene and sample over all metrics, by the p-value of the gene and then of the junction; rows without a gene go."""
    order = Window.partitionBy(gene, "sample_id").orderBy(F.asc_nulls_last("p_value_gene"), F.asc_nulls_last("p_value"), "type", "junction_id")
    return results.filter(F.col(gene).isNotNull()).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def with_fdr_sets(parts: dict[str, DataFrame], keys: list[str], padj: str = "padjust") -> DataFrame:
    """The union of results by FDR set (transcriptome-wide and named subsets) as one row for each cell, with a column of adjusted p-values for each set."""
    rows = None
    for name, df in parts.items():
        one = df.withColumn("fdr_set", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, padj, "fdr_set")]
    wide = rows.groupBy(*keys).pivot("fdr_set", list(parts)).agg(F.first(padj, ignorenulls=True))
    wide = wide.withColumnsRenamed({n: f"{padj}_{n}" for n in parts})
    facts = rows.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])
    return facts.join(wide, keys)


def feature_index(features: DataFrame, table: DataFrame, key: str = "junction_id") -> DataFrame:
    """``table`` with the id of the feature of exactly its range; a range of none or of several is an error of the row's own, NULL."""
    on = ["seqname", "start", "end", "strand"]
    ids = features.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("index")).withColumn("index", F.when(F.col("_n") == 1, F.col("index"))).drop("_n")
    return table.join(ids, on, "left")


def best_per_gene(results: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each gene (and sample) by p-value and then by size of delta."""
    order = Window.partitionBy(*keys).orderBy("p_value", F.desc(F.abs("delta")), "junction_id")
    return results.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def fdr_sets(rows: DataFrame, keys: list[str], sets: list[str]) -> DataFrame:
    """One column padj_<set> for each FDR set; rows outside a set have NULL."""
    return rows.groupBy(*keys).pivot("fdr_set", sets).agg(F.first("padj")).withColumnsRenamed({s: f"padj_{s}" for s in sets})


def qq(p: DataFrame, by: list[str], value: str = "p") -> DataFrame:
    """Observed and expected -log10 p-values, by rank."""
    w = Window.partitionBy(*by)
    ranked = p.filter(F.col(value).isNotNull()).withColumns({"rank": F.row_number().over(w.orderBy(value, "junction_id")), "n": F.count(F.lit(1)).over(w)})
    a = F.when(F.col("n") <= 10, 3 / 8).otherwise(0.5)
    return ranked.withColumns({"expected": -F.log10((F.col("rank") - a) / (F.col("n") + 1 - 2 * a)), "observed": -F.log10(F.greatest(F.col(value), F.lit(1e-300)))})


def metric_ranks(cells: DataFrame, value: str, seed: int | None = None) -> DataFrame:
    """Rank of a value among the samples of a junction, NULL first, ties at random or by sample."""
    tie = draw(seed, "junction_id", "sample_id") if seed is not None else F.col("sample_id")
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy("junction_id").orderBy(F.asc_nulls_first(value), tie)))


def expression_histogram(cells: DataFrame, bins: int = 200, top: float = 8.0) -> DataFrame:
    """Junctions by the logarithm of their geometric mean count."""
    mean = cells.groupBy("junction_id").agg(F.avg(F.log1p("k")).alias("v"))
    return mean.groupBy(F.width_bucket(F.round("v", 9), F.lit(0.0), F.lit(top), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_correlation(cells: DataFrame, value: str) -> DataFrame:
    """Spearman correlation of every pair of samples over the junctions that both have a value of, from average ranks within a sample.

    Each junction is an array over the samples; a task adds up sums, squares and products of its arrays as samples x samples matrices, so a pair
    of samples leaves a task as one row, however many junctions there are.
    """
    w = Window.partitionBy("sample_id")
    tie = Window.partitionBy("sample_id", value)
    ranked = cells.filter(F.col(value).isNotNull()).withColumn("r", F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(tie) - 1) / 2)
    samples = [r.sample_id for r in cells.select("sample_id").distinct().sort("sample_id").collect()]  # one row for each sample
    packed = ranked.groupBy("junction_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", F.col("r").cast("double")))).alias("m"))
    rows = packed.select(F.array(*[F.element_at("m", F.lit(s)) for s in samples]).alias("r"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(samples), len(samples)))
        for batch in batches:
            x = np.asarray(batch.column("r").flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), len(samples))
            have = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x])
        i, j = np.triu_indices(len(samples), 1)
        cols = [total[0][i, j], total[1][i, j], total[1][j, i], total[2][i, j], total[2][j, i], total[3][i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(c) for c in cols)], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    names = F.array(*[F.lit(s) for s in samples])
    out = rows.mapInArrow(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    spread = F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    return out.filter("n > 0").select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), (cov / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def manhattan(results: DataFrame) -> DataFrame:
    """One point for each site and sample: the smallest p-value at it, by position."""
    return results.groupBy("seqname", "start", "sample_id").agg(F.min("p").alias("p")).withColumn("log_p", -F.log10(F.greatest("p", F.lit(1e-300))))
