"""Splicing ratios and their row statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..dataset import SpliceDataset


def ratio(k: Column, n: Column) -> Column:
    """k/n, NULL where n is 0."""
    return k / F.nullif(n, F.lit(0))


def prime_sites(ds: SpliceDataset) -> DataFrame:
    """Grid with o_psi5, o_psi3, psi5, psi3: the other reads of the donor and of the acceptor; 0 of 0 counts as 1."""
    cells = ds.grid().withColumn("minus", F.col("strand") == "-")
    at = lambda end: F.sum("k").over(Window.partitionBy("sample_id", "minus", "seqname", end)) - F.col("k")
    cells = cells.withColumns({"at_start": at("start"), "at_end": at("end")})
    out = cells.withColumns({"o_psi5": F.when(F.col("minus"), F.col("at_end")).otherwise(F.col("at_start")), "o_psi3": F.when(F.col("minus"), F.col("at_start")).otherwise(F.col("at_end"))})
    out = out.withColumns({m: F.coalesce(ratio(F.col("k"), F.col("k") + F.col(f"o_{m}")), F.lit(1.0)) for m in ("psi5", "psi3")})
    return out.drop("minus", "at_start", "at_end")


def site_theta(ds: SpliceDataset) -> DataFrame:
    """Site grid with o_theta (split reads of the junctions at the site) and theta, the share of nonsplit reads."""
    ends = ds.junctions.select("junction_id", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("site_id"))
    split = ds.j_counts.join(ends, "junction_id").groupBy("site_id", "sample_id").agg(F.sum("k").alias("o_theta"))
    out = ds.site_grid().join(split, ["site_id", "sample_id"], "left").withColumn("o_theta", F.coalesce("o_theta", F.lit(0)))
    return out.withColumn("theta", F.coalesce(ratio(F.col("k"), F.col("k") + F.col("o_theta")), F.lit(1.0)))


def nonsplit_sums(ds: SpliceDataset) -> DataFrame:
    """junction_id, sample_id, nonsplit: nonsplit reads of both sites, 0 where a site has none."""
    ends = ds.junctions.select("junction_id", F.explode(F.array("start_id", "end_id")).alias("site_id"))
    return ds.ss_counts.join(ends, "site_id").groupBy("junction_id", "sample_id").agg(F.sum("k").alias("nonsplit"))


def intron_jaccard(ds: SpliceDataset) -> DataFrame:
    """The prime-site grid with nonsplit, n_jaccard, o_jaccard and jaccard; 0 of 0 is NULL."""
    cells = prime_sites(ds).join(nonsplit_sums(ds), ["junction_id", "sample_id"], "left").withColumn("nonsplit", F.coalesce("nonsplit", F.lit(0)))
    n = F.col("k") + F.col("o_psi3") + F.col("o_psi5") + F.col("nonsplit")
    return cells.withColumn("n_jaccard", n).withColumns({"o_jaccard": F.col("n_jaccard") - F.col("k"), "jaccard": ratio(F.col("k"), F.col("n_jaccard"))})


def delta_median(cells: DataFrame, value: str, by: str = "junction_id") -> DataFrame:
    """``value`` minus its median over the samples of a row."""
    mid = cells.groupBy(by).agg(F.median(value).alias("mid"))
    return cells.join(mid, by).withColumn(f"delta_median_{value}", F.col(value) - F.col("mid")).drop("mid")


def row_stats(cells: DataFrame, value: str, by: str = "junction_id") -> DataFrame:
    v = F.col(value)
    return cells.groupBy(by).agg(F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.75)).alias("q75"), F.stddev_samp(v).alias("sd"), F.sum(v).alias("sum"))


def site_index(ds: SpliceDataset, metric: str) -> DataFrame:
    """junction_id (site_id for theta) and the group in which a metric's values are compared."""
    if metric == "theta":
        return ds.sites.select("site_id", F.col("site_id").alias("index"))
    if metric == "jaccard":
        return ds.junctions.select("junction_id", F.col("junction_id").alias("index"))
    five = F.when(F.col("strand") == "-", F.col("end_id")).otherwise(F.col("start_id"))
    three = F.when(F.col("strand") == "-", F.col("start_id")).otherwise(F.col("end_id"))
    return ds.junctions.select("junction_id", (five if metric == "psi5" else three).alias("index"))


def abs_max_by_group(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of the largest absolute size in each group, the first by ``order`` on ties."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.abs(value), -F.col(order))).alias(value))


def first_by_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def residual(k: str, n: str, mu: str, pseudocount: float = 0.1) -> Column:
    """The logit of a ratio with pseudocounts less that of its prediction."""
    return F.ln((F.col(k) + pseudocount) / (F.col(n) - F.col(k) + pseudocount)) - F.ln(F.col(mu) / (1 - F.col(mu)))


def z_score(k: str, n: str, mu: str, by: str = "junction_id", pseudocount: float = 0.1, centred: bool = True) -> Column:
    """Residuals of a row in units of their standard deviation; NULL where that is 0."""
    r, row = residual(k, n, mu, pseudocount), Window.partitionBy(by)
    return (r - F.avg(r).over(row) if centred else r) / F.nullif(F.stddev_samp(r).over(row), F.lit(0.0))


def huber_weight(k: str, n: str, mu: str, rho: str, c: float = 1.345) -> Column:
    """Weight of a cell by its Pearson residual under the beta-binomial: 1 up to c, c / |r| beyond, 0 without a residual."""
    kk, nn, m = F.col(k), F.col(n), F.col(mu)
    r = (kk - nn * m) / F.nullif(F.sqrt(nn * m * (1 - m) * (1 + (nn - 1) * F.col(rho))), F.lit(0.0))
    return F.when(r.isNull(), F.lit(0.0)).when(F.abs(r) > c, c / F.abs(r)).otherwise(F.lit(1.0))


def all_ratios(ds: SpliceDataset, of: tuple[str, ...] = ("jaccard", "psi5", "psi3")) -> DataFrame:
    """The grid with the ratios asked for and each one's distance from its median over samples; the jaccard index is always there."""
    out = intron_jaccard(ds)
    for m in dict.fromkeys(("jaccard", *of)):
        if m != "theta":
            out = out.withColumn(f"delta_median_{m}", F.col(m) - F.median(m).over(Window.partitionBy("junction_id")))
    return out
