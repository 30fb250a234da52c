"""Expression and variability filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..dataset import SpliceDataset
from . import metrics
from .ranks import draw


def expression(cells: DataFrame, min_expression: int = 20, quantile: float = 0.75, min_quantile: float = 10, jaccard: bool = True) -> DataFrame:
    """junction_id, max_count, the quantiles, passed_expression; ``cells`` come from intron_jaccard."""
    n = [("q_jaccard", F.col("n_jaccard"))] if jaccard else [("q_psi5", F.col("k") + F.col("o_psi5")), ("q_psi3", F.col("k") + F.col("o_psi3"))]
    out = cells.groupBy("junction_id").agg(F.max("k").alias("max_count"), *[F.percentile(v, F.lit(quantile)).alias(c) for c, v in n])
    passed = F.col("max_count") >= min_expression
    for c, _ in n:
        passed &= F.col(c) >= min_quantile
    return out.withColumn("passed_expression", passed)


def max_deviation(cells: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """The largest distance of a value from its row mean to nine digits, so that the order of a sum decides nothing; NULLs left out, 0 at least."""
    mean = F.avg(value).over(Window.partitionBy(by))
    return cells.withColumn("_d", F.abs(F.col(value) - mean)).groupBy(by).agg(F.round(F.coalesce(F.greatest(F.max("_d"), F.lit(0.0)), F.lit(0.0)), 9).alias(name))


def variability(cells: DataFrame, min_delta: float = 0.0) -> DataFrame:
    out = max_deviation(cells, "jaccard", "junction_id", "max_d_jaccard")
    return out.withColumn("passed_variability", F.col("max_d_jaccard") >= min_delta)


def variability_by_site(ds: SpliceDataset, cells: DataFrame, theta: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """The older rule: the largest of psi5, psi3 and the theta of both sites."""
    out = max_deviation(cells, "psi5", "junction_id", "max_d_psi5").join(max_deviation(cells, "psi3", "junction_id", "max_d_psi3"), "junction_id").join(ds.junctions.select("junction_id", "start_id", "end_id"), "junction_id")
    d = max_deviation(theta, "theta", "site_id", "d")
    for end in ("start", "end"):
        out = out.join(d.select(F.col("site_id").alias(f"{end}_id"), F.col("d").alias(f"max_d_theta_{end}")), f"{end}_id", "left")
    top = F.greatest("max_d_psi5", "max_d_psi3", "max_d_theta_start", "max_d_theta_end")
    return out.select("junction_id", "max_d_psi5", "max_d_psi3", "max_d_theta_start", "max_d_theta_end", (top >= min_delta).alias("passed_variability"))


def expression_and_variability(cells: DataFrame, min_expression: int = 20, quantile: float = 0.75, min_quantile: float = 10, min_delta: float = 0.0) -> DataFrame:
    both = expression(cells, min_expression, quantile, min_quantile).join(variability(cells, min_delta), "junction_id")
    return both.withColumn("passed", F.col("passed_expression") & F.col("passed_variability"))


def split_by_filter(ds: SpliceDataset, judged: DataFrame, flag: str = "passed") -> tuple[SpliceDataset, SpliceDataset]:
    """The dataset that passed, and the rest."""
    return ds.subset(junctions=judged.filter(F.col(flag))), ds.subset(junctions=judged.filter(~F.coalesce(F.col(flag), F.lit(False))))


def rare_junctions(judged: DataFrame, min_expression: int = 20) -> DataFrame:
    """Expressed in one sample, but failing the quantile."""
    return judged.filter((F.col("max_count") >= min_expression) & ~F.col("passed_expression"))


def variable_junctions(cells: DataFrame, value: str, min_delta: float = 0.1) -> DataFrame:
    return max_deviation(cells, value, "junction_id", "d").select("junction_id", (F.col("d") >= min_delta).alias("variable"))


def most_variable(cells: DataFrame, n: int, seed: int | None = None, pseudocount: float = 0.1) -> DataFrame:
    """Of the 2n junctions of the largest spread of logit ratios n at random (the first n without a seed)."""
    x = F.ln((F.col("k") + pseudocount) / (F.col("n_jaccard") - F.col("k") + pseudocount))
    top = cells.groupBy("junction_id").agg(F.stddev_samp(x).alias("sd")).orderBy(F.desc_nulls_last(F.round("sd", 9)), "junction_id").limit(2 * n)
    return top.orderBy(draw(seed, "junction_id") if seed is not None else F.desc_nulls_last(F.round("sd", 9)), "junction_id").limit(n)


def feature_mask(features: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """included: True unless the mask says otherwise."""
    if mask is None:
        return features.withColumn("included", F.lit(True))
    return features.join(mask.select("junction_id", F.col("included").alias("_m")), "junction_id", "left").withColumn("included", F.coalesce("_m", F.lit(True))).drop("_m")
