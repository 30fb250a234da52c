"""Simulated cohorts and label expressions."""

from pyspark.sql import functions as F

from junctura.functions import links
from junctura.sources import simulate


def test_simulated_counts(spark):
    a = simulate.beta_binomial(spark, 6, 20, 2)
    assert a.count() == 120 and a.filter("k > n or k < 0").isEmpty()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, simulate.beta_binomial(spark, 6, 20, 2).repartition(3).collect()))
    b = simulate.dirichlet_multinomial(spark, 5, 20, 8)
    split = b.withColumn("g", F.col("junction_id") % 8).groupBy("g", "sample_id").agg(F.sum("k").alias("k"), F.max("n").alias("n"))
    assert b.count() == 100 and split.filter("k <> n").isEmpty()


def test_links(spark):
    row = spark.createDataFrame([("chr1", 5, 9, "A B", 1.0)], "seqname string, start int, end int, gene string, psi double").select(links.position().alias("p"), links.link(links.gene_url("https://example.org/"), F.col("gene")).alias("l"), F.round(links.capped_logit("psi"), 3).alias("c")).first()
    assert row.p == "chr1:5-9" and row.l == '<a href="https://example.org/A+B" target="_blank">A B</a>' and row.c == 4.595
