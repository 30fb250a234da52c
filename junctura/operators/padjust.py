"""Multiple testing: p-value adjustment as windows, per family of tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Those that windows express, and Hommel's, which needs a family as a whole.
METHODS = ("BH", "BY", "holm", "hochberg", "bonferroni", "none")
HOMMEL = "hommel"


def adjusted(df: DataFrame, p: str, by: list[str], ids: list[str], method: str = "BY", name: str = "padj") -> DataFrame:
    """``df`` with the adjusted p-value; NULL p stays NULL and is not counted. BH, BY, holm, hochberg, bonferroni, none and hommel.

    ``by`` is a family, such as a sample: there are many of them, so the windows spread over the cluster.
    """
    if method == HOMMEL:
        return _hommel(df, p, by, name)
    if method not in METHODS:
        raise ValueError(f"method must be one of {(*METHODS, HOMMEL)}")
    null = F.col(p).isNull()
    family = Window.partitionBy(*by, null)
    up = family.orderBy(p, *ids)
    rn, m = F.row_number().over(up), F.count(p).over(family)
    v = F.col("_p")
    if method in ("BH", "BY"):
        # the harmonic number of the family, summed once over its ranks
        factor = F.lit(1.0) if method == "BH" else F.sum(1.0 / F.col("_rn")).over(family)
        term, window, agg = F.col(p) * F.col("_m") / F.col("_rn") * factor, family.orderBy(F.desc("_rn")), F.min
    elif method == "holm":
        term, window, agg = F.col(p) * (F.col("_m") - F.col("_rn") + 1), family.orderBy("_rn"), F.max
    elif method == "hochberg":
        term, window, agg = F.col(p) * (F.col("_m") - F.col("_rn") + 1), family.orderBy(F.desc("_rn")), F.min
    else:
        term, window, agg = F.col(p) * (F.col("_m") if method == "bonferroni" else F.lit(1)), None, None
    out = df.withColumns({"_rn": rn, "_m": m}).withColumn("_p", term)
    value = v if window is None else agg(v).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(F.col(p).isNull(), None).otherwise(F.least(F.lit(1.0), value))).drop("_rn", "_m", "_p")


def hommel(p: np.ndarray) -> np.ndarray:
    """Adjusted p-values by closed testing with Simes' test, for one family without missing values.

    simes[m] is the p-value of the intersection of the m largest, m times the least slope from their left neighbour's rank to one of their points; it falls with m. A hypothesis of rank i is
    adjusted to the largest of min(m p, simes[m]) over the intersections of m that leave it out of the m - 1 largest, and of simes[n - i + 2]: the first term
    rises and the second falls, so the place where they cross is found by bisection.
    """
    n = len(p)
    if n < 2:
        return p.astype(float)
    order = np.argsort(p, kind="stable")
    q = p[order].astype(float)
    simes = np.full(n + 2, -np.inf)
    hull: list[tuple[int, float]] = []  # the lower convex hull of (rank, p) from the last rank to the first
    for k in range(n, 0, -1):
        at = (k, q[k - 1])
        while len(hull) > 1 and (hull[-2][1] - at[1]) * (hull[-1][0] - at[0]) <= (hull[-1][1] - at[1]) * (hull[-2][0] - at[0]):
            hull.pop()
        hull.append(at)
        lo, hi = 0, len(hull) - 1  # the slope from (k - 1, 0) falls, then rises along the hull
        while lo < hi:
            mid = (lo + hi) // 2
            a, b = hull[mid], hull[mid + 1]
            if a[1] * (b[0] - k + 1) <= b[1] * (a[0] - k + 1):
                hi = mid
            else:
                lo = mid + 1
        simes[n - k + 1] = (n - k + 1) * hull[lo][1] / (hull[lo][0] - k + 1)
    rank = np.arange(1, n + 1)
    # the largest m with m p <= simes[m], among 1 .. n - rank + 1; 0 where there is none
    lo, hi = np.zeros(n, np.int64), n - rank + 1
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        fits = mid * q <= simes[mid]
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, np.minimum(hi, mid - 1))
    crossed = np.where(lo < n - rank + 1, simes[np.minimum(lo + 1, n)], -np.inf)
    out = np.maximum.reduce([lo * q, crossed, np.where(rank > 1, simes[np.minimum(n - rank + 2, n + 1)], -np.inf), q])
    back = np.empty(n)
    back[order] = np.minimum(out, 1.0)
    return back


def _hommel(df: DataFrame, p: str, by: list[str], name: str) -> DataFrame:
    """A family is one group of a task, as it is one window of the other methods."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(block: pa.Table) -> pa.Table:
        v = block.column(p).to_numpy().astype(float)
        known = ~np.isnan(v)
        out = np.full(len(v), np.nan)
        out[known] = hommel(v[known])
        return block.append_column(name, pa.array(out, mask=~known))

    return df.groupBy(*by).applyInArrow(run, schema)


def least_holm(p: str, by: list[str], mask: Column | None = None) -> Column:
    """The least Holm-adjusted p-value of a group, for each of its rows: min(1, n min p)."""
    v = F.when(mask, F.col(p)) if mask is not None else F.col(p)
    w = Window.partitionBy(*by)
    return F.when(F.count(v).over(w) > 0, F.least(F.lit(1.0), F.count(v).over(w) * F.min(v).over(w)))


def fdr_per_sample(df: DataFrame, p: str = "p", sample: str = "sample_id", index: str = "index", method: str = "BY", rho: str | None = None, rho_cutoff: float | None = None) -> DataFrame:
    """Family-wise p-value of each (sample, index), then the false discovery rate over the indices of a sample."""
    mask = None if rho is None or rho_cutoff is None else F.col(rho) <= rho_cutoff
    site = Window.partitionBy(sample, index)
    # one row of a site stands for it in the sample's family; its adjusted value goes back to the others by a window, not by a join
    fwer = df.withColumn("p_site", least_holm(p, [sample, index], mask)).withColumn("_first", F.row_number().over(site.orderBy(F.col(p).asc_nulls_last())) == 1)
    one = adjusted(fwer.withColumn("_one", F.when(F.col("_first"), F.col("p_site"))), "_one", [sample], [index], method)
    return one.withColumn("padj", F.max("padj").over(site)).drop("_first", "_one")


def gene_p_values(df: DataFrame, genes: DataFrame, feature: str = "junction_id", p: str = "p", sample: str = "sample_id", index: str = "index", method: str = "BY") -> DataFrame:
    """gene, sample, p_gene (least Holm over the distinct sites of a gene) and padj_gene.

    ``genes``: feature and gene, several rows for a feature of several genes.
    """
    sites = df.select(feature, sample, index, p).join(genes, feature).groupBy("gene", sample, index).agg(F.min(p).alias("p"))
    one = sites.groupBy("gene", sample).agg(F.count("p").alias("n"), F.min("p").alias("least")).select("gene", sample, F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n") * F.col("least"))).alias("p_gene"))
    return adjusted(one, "p_gene", [sample], ["gene"], method, "padj_gene")


def gene_fdr_on_subset(gene_p: DataFrame, subset: DataFrame, sample: str = "sample_id", method: str = "BY") -> DataFrame:
    """gene, sample, p_gene and padj_gene, adjusted over the genes that ``subset`` (sample, gene) has for the sample; other genes are not there.

    ``gene_p``: p_gene of every gene and sample. Which genes are tested decides the adjustment only, not a gene's own p-value.
    """
    own = gene_p.select("gene", sample, "p_gene").join(subset.select(sample, "gene").distinct(), [sample, "gene"], "left_semi")
    return adjusted(own, "p_gene", [sample], ["gene"], method, "padj_gene")


def fdr_on_subset(df: DataFrame, subset: DataFrame, p: str = "p_site", sample: str = "sample_id", index: str = "index", method: str = "BY") -> DataFrame:
    """padj_subset over the rows of ``subset`` (subset, sample, index) only; all other rows NULL."""
    one = df.groupBy(sample, index).agg(F.first(p, ignorenulls=True).alias(p)).join(subset.distinct(), [sample, index])
    return adjusted(one, p, ["subset", sample], [index], method, "padj_subset")
