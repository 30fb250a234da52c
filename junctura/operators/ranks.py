"""Orders over whole tables without one task that holds them: sorted ranges, each with the count of what lies before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources import shared


def draw(seed: int, *keys: str) -> Column:
    """A number from 0 up to 1 that depends on the seed and the keys alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row, from 1, in an order that should leave no ties.

    Rows are dealt to ranges by the order and numbered within a range; the ranges' sizes, one row for each, add up to what lies before.
    """
    ranged = shared.written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def group_numbers(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the number of each group, groups in the order of their first row."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(first, ["_first", *keys], "group_number").drop("_first")


def genomic_order(df: DataFrame, chromosomes: list[str] | None = None) -> DataFrame:
    """Rows by chromosome (in the order given, else numbers before names), strand (+, -, *), start and end."""
    if chromosomes:
        at = F.coalesce(F.array_position(F.array(*map(F.lit, chromosomes)), F.col("seqname")), F.lit(0))
        first = F.when(at == 0, F.lit(len(chromosomes) + 1)).otherwise(at)
    else:
        first = F.coalesce(F.regexp_extract("seqname", r"^(?:chr)?(\d+)$", 1).try_cast("int"), F.lit(1 << 30))
    strand = F.array_position(F.array(F.lit("+"), F.lit("-"), F.lit("*")), F.col("strand"))
    return df.orderBy(first, "seqname", strand, "start", "end")


def precision_recall(scored: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """score, tp and fp: how many true and false rows have this score or a higher one, within each group of ``by``."""
    by = by or []
    points = scored.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label)).alias("t"), F.count_if(~F.col(label)).alias("f"))
    ranged = shared.written(points.repartitionByRange(*by, F.desc("score")).withColumn("_range", F.spark_partition_id()), "scores")
    row = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*by, "_range").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).select(*by, "_range", F.coalesce(F.sum("t").over(row), F.lit(0)).alias("_t"), F.coalesce(F.sum("f").over(row), F.lit(0)).alias("_f"))
    own = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    swept = ranged.withColumns({"tp": F.sum("t").over(own), "fp": F.sum("f").over(own)}).join(before, [*by, "_range"])
    return swept.select(*by, "score", (F.col("tp") + F.col("_t")).alias("tp"), (F.col("fp") + F.col("_f")).alias("fp"), "t", "f")


def precision_recall_auc(scored: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """One row (or one for each group of ``by``): the area under the precision-recall curve, false positives interpolated linearly in true ones between two scores.

    NULL scores come last, as one below the least.
    """
    by = by or []
    least = scored.agg(F.min(score)).first()[0]
    filled = scored.withColumn(score, F.coalesce(F.col(score), F.lit(0.0 if least is None else float(least) - 1)))
    curve = precision_recall(filled, score, label, by)
    t1, f1 = F.col("tp").cast("double"), F.col("fp").cast("double")
    t0, f0 = t1 - F.col("t"), f1 - F.col("f")
    h = F.col("f") / F.col("t")
    c = f0 - h * t0
    # the integral of t / ((1 + h) t + c) from t0 to t1
    whole = lambda t: t / (1 + h) - F.when(c == 0, F.lit(0.0)).otherwise(c / ((1 + h) * (1 + h)) * F.ln((1 + h) * t + c))
    area = F.when(F.col("t") > 0, whole(t1) - whole(t0))
    totals = [F.sum(area).alias("area"), F.sum("t").alias("p")]
    total = curve.groupBy(*by).agg(*totals) if by else curve.agg(*totals)
    return total.select(*by, (F.col("area") / F.nullif(F.col("p"), F.lit(0))).alias("auc"))
