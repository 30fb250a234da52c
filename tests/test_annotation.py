"""Impact labels on small fixtures, and on all samples of the cohort."""

from junctura.operators import annotation
from junctura.plans import fits

RANGE = "seqname string, start long, end long, strand string"


def test_labels_of_junctions(spark):
    genes = spark.createDataFrame([("g1", "c", 1000, 3000, "+"), ("g2", "c", 5000, 7000, "+")], f"gene_id string, {RANGE}")
    exons = spark.createDataFrame([("c", 1000, 1100, "+"), ("c", 2000, 2100, "+"), ("c", 5000, 5100, "+")], RANGE)
    use = spark.createDataFrame([("c", 1101, 1999, 20.0)], "seqname string, start long, end long, median_count double")
    rows = [
        (1, 1, 1101, 1999, "both", -0.3, 0.5, 0.2, 10), (1, 2, 1101, 1999, "both", -0.3, 0.5, 0.2, 9), (1, 3, 1101, 1999, "both", -0.3, 0.24, 0.2, 50), (1, 4, 1101, 1999, "both", 0.3, 0.5, 0.2, 50),
        (2, 1, 1101, 4000, "start", 0.1, 0.0, 0.0, 0), (3, 1, 1101, 6000, "start", 0.1, 0.0, 0.0, 0), (4, 1, 1101, 2500, "start", 0.1, 0.0, 0.0, 0),
        (5, 1, 2500, 3500, "none", 0.1, 0.0, 0.0, 0), (6, 1, 2200, 2900, "none", 0.1, 0.0, 0.0, 0), (7, 1, 8000, 8100, "none", 0.1, 0.0, 0.0, 0), (8, 1, 100, 200, "none", 0.1, 0.0, 0.0, 0),
    ]
    df = spark.createDataFrame([(j, s, "c", a, b, "+", k, d, p, q, n) for j, s, a, b, k, d, p, q, n in rows], f"junction_id long, sample_id long, {RANGE}, annotated string, delta double, nonsplit_proportion double, nonsplit_q99 double, nonsplit_counts long")
    found = annotation.impact(df, use, exons, genes).collect()
    assert len(found) == len(rows)
    got = {(r.junction_id, r.sample_id): (r.impact, r.frameshift) for r in found}
    assert got == {
        (1, 1): ("(partial)intronRetention", "inconclusive"), (1, 2): ("annotatedIntron_reducedUsage", "unlikely"), (1, 3): ("annotatedIntron_reducedUsage", "unlikely"), (1, 4): ("annotatedIntron_increasedUsage", "unlikely"),
        (2, 1): ("splicingBeyondGene", "inconclusive"), (3, 1): ("multigenicSplicing", "inconclusive"), (4, 1): ("singleExonSkipping", "likely"),
        (5, 1): ("splicingBeyondGene", "inconclusive"), (6, 1): ("complex", "inconclusive"), (7, 1): ("downstreamOfNearestGene", "unlikely"), (8, 1): ("upstreamOfNearestGene", "unlikely"),
    }


def test_labels_of_sites(spark):
    genes = spark.createDataFrame([("g1", "c", 1000, 3000, "+")], f"gene_id string, {RANGE}")
    exons, introns = spark.createDataFrame([("c", 1000, 1100, "+")], RANGE), spark.createDataFrame([("c", 1101, 1999, "+")], RANGE)
    sites = spark.createDataFrame([(i, "c", s, s + 1, "+") for i, s in enumerate((1050, 1100, 1500, 2500, 100, 4000))], f"site_id long, {RANGE}")
    got = {r.site_id: r.impact for r in annotation.theta_impact(sites, introns, exons, genes).collect()}
    assert got == {0: "exonicRegion", 1: "annotatedSpliceSite", 2: "intronicRegion", 3: None, 4: "upstreamOfNearestGene", 5: "downstreamOfNearestGene"}


def test_impact_of_all_samples(spark, sf_dir):
    out = fits.junction_impact(spark, sf_dir).cache()
    ds = fits.cohort(spark, sf_dir)
    assert out.filter("type = 'jaccard'").count() == ds.grid().count() and out.filter("type = 'theta'").count() == ds.site_grid().count()
    assert out.select("sample_id").distinct().count() == 25


def test_one_known_intron_decides(spark):
    introns = spark.createDataFrame([("c", 100, 200, "+", 5.0, "t1"), ("c", 100, 300, "+", 9.0, "t2"), ("c", 250, 400, "+", 1.0, "t3"), ("c", 250, 400, "+", 1.0, "t4")], f"{RANGE}, median_count double, transcript_id string")
    j = spark.createDataFrame([(1, "c", 100, 200, "+"), (2, "c", 150, 300, "+"), (3, "c", 100, 300, "+"), (4, "c", 100, 400, "+"), (5, "c", 250, 400, "+"), (6, "c", 350, 400, "*"), (7, "c", 900, 950, "+"), (8, "c", 100, 200, "-")], f"junction_id long, {RANGE}")
    got = {r.junction_id: r.annotated for r in annotation.reference_overlap(j, introns).collect()}
    # the intron of the highest median is the only one compared: 1 and 4 share its start, 5 overlaps it but shares no end
    assert got == {1: "start", 2: "end", 3: "both", 4: "start", 5: "none", 6: "end", 7: "none", 8: "none"}
    known = {r.junction_id: (r.known_intron, r.known_start, r.known_end, r.transcripts) for r in annotation.known_ends(j, introns).collect()}
    assert known[1] == (True, True, True, "t1") and known[4] == (False, True, True, None) and known[5] == (True, True, True, "t3,t4") and known[8] == (False, False, False, None)


def test_utrs_count_at_the_ends_of_a_junction(spark):
    j = spark.createDataFrame([(1, "c", 100, 200, "+"), (2, "c", 300, 400, "+"), (3, "c", 500, 600, "+"), (4, "c", 700, 800, "+")], f"junction_id long, {RANGE}")
    five = spark.createDataFrame([("c", 90, 95, "+"), ("c", 340, 360, "+")], RANGE)  # touches the bases before 1, lies inside of 2
    three = spark.createDataFrame([("c", 205, 210, "+"), ("c", 605, 605, "+"), ("c", 806, 900, "+")], RANGE)
    got = {r.junction_id: r.utr for r in annotation.utr_label(j, five, three, "junction_id").collect()}
    assert got == {1: "5'-UTR", 2: "no", 3: "3'-UTR", 4: "no"}


def test_unstranded_features_ignore_the_strand_of_genes(spark):
    genes = spark.createDataFrame([("g", "A", "c", 1, 50, "+"), ("h", "B", "c", 1, 50, "-")], f"gene_id string, symbol string, {RANGE}")
    both = spark.createDataFrame([(1, "c", 10, 20, "+"), (2, "c", 10, 20, "*")], f"junction_id long, {RANGE}")
    label = lambda df: {r.junction_id: r.genes for r in annotation.gene_labels(df, genes, "junction_id").collect()}
    assert label(both) == {1: "A;B", 2: "A;B"} and label(both.filter("junction_id = 1")) == {1: "A"}


def test_sweeps_in_tiles_equal_one_sweep(spark):
    from pyspark.sql import functions as F

    from junctura.operators import intervals

    a = spark.range(200).select(F.col("id").alias("key"), F.concat(F.lit("c"), F.col("id") % 2).alias("seqname"), (F.col("id") * 7919 % 1000).alias("start")).withColumn("end", F.col("start") + F.col("key") % 13)
    b = spark.range(40).select(F.col("id").alias("gene"), F.concat(F.lit("c"), F.col("id") % 3).alias("seqname"), (F.col("id") * 104729 % 1000).alias("start")).withColumn("end", F.col("start") + F.col("gene") % 90)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    near = lambda tile: rows(intervals.nearest(a, b, "key", "gene", tile).select("key", "distance"))
    assert near(10) == near(100) == near(10**9)
    depth = lambda tile: rows(intervals.coverage(a, [], tile))
    assert depth(10) == depth(10**9)
    covered = {(r.seqname, x): r.depth for r in intervals.coverage(a, [], 50).collect() for x in range(r.start, r.end + 1)}
    want: dict = {}
    for r in a.collect():
        for x in range(r.start, r.end + 1):
            want[r.seqname, x] = want.get((r.seqname, x), 0) + 1
    assert covered == want
