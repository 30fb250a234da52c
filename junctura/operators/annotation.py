"""Annotation of junctions with genes, known introns, blacklists, UTRs and their likely impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import intervals


def gene_labels(features: DataFrame, genes: DataFrame, key: str, width: int = 5000) -> DataFrame:
    """key and the distinct symbols of overlapping genes, in order, joined by ``;``; if some feature has no strand, no gene's strand counts."""
    unstranded = features.agg(F.coalesce(F.bool_or(F.col("strand") == "*"), F.lit(False))).scalar()
    genes = genes.withColumn("strand", F.when(unstranded, "*").otherwise(F.col("strand")))
    pairs = intervals.overlap(features, genes, width).select(F.col(f"a.{key}").alias(key), F.col("b.symbol").alias("symbol")).distinct()
    return features.select(key).join(pairs.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("symbol")), ";").alias("genes")), key, "left")


def with_symbols(genes: DataFrame, names: DataFrame) -> DataFrame:
    """``genes`` with the symbol of their gene_id in ``names`` (gene_id, symbol), the first by name of several; the id itself where there is none."""
    one = names.groupBy("gene_id").agg(F.min("symbol").alias("symbol"))
    return genes.drop("symbol").join(one, "gene_id", "left").withColumn("symbol", F.coalesce("symbol", "gene_id"))


def annotated_results(results: DataFrame, introns: DataFrame | None = None, utrs: tuple[DataFrame, DataFrame] | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Result rows with what is known of their junction: annotated ends, UTR (five, three) and blacklisted regions, each where its table is given."""
    j = results.select("junction_id", "seqname", "start", "end", "strand").distinct()
    out = results
    if introns is not None:
        out = out.join(reference_overlap(j, introns), "junction_id", "left")
    if utrs is not None:
        out = out.join(utr_label(j, *utrs, "junction_id"), "junction_id", "left")
    if blacklist is not None:
        out = out.join(blacklisted(j, blacklist), "junction_id", "left")
    return out


def split_genes(df: DataFrame, column: str = "genes", sep: str = ";") -> DataFrame:
    """A row for each gene of a label."""
    return df.withColumn("gene", F.explode_outer(F.split(column, sep)))


def short_label(column: str, most: int = 3) -> Column:
    parts = F.split(column, ";")
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), ";"), F.lit("..."))).otherwise(F.col(column))


def known_ends(junctions: DataFrame, introns: DataFrame) -> DataFrame:
    """junction_id, whether a known intron is the same, begins and ends with it, and the names of the transcripts of equal introns, if ``introns`` has them."""
    j = junctions.select("junction_id", "seqname", "start", "end", "strand")
    key = F.col("a.junction_id").alias("junction_id")
    out = j.select("junction_id")
    for kind, name in (("equal", "known_intron"), ("start", "known_start"), ("end", "known_end")):
        hit = intervals.overlap(j, introns, kind=kind).select(key).distinct().withColumn(name, F.lit(True))
        out = out.join(hit, "junction_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if "transcript_id" in introns.columns:
        out = out.join(joined_names(intervals.overlap(j, introns, kind="equal").select(key, F.col("b.transcript_id").alias("name")), "junction_id"), "junction_id", "left").withColumnRenamed("names", "transcripts")
    return out


def joined_names(pairs: DataFrame, key: str, sep: str = ",") -> DataFrame:
    """key and its distinct names, in order, joined by ``sep``."""
    return pairs.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("name")), sep).alias("names"))


def reference_overlap(junctions: DataFrame, introns: DataFrame, width: int = 5000) -> DataFrame:
    """junction_id and annotated: both, start, end or none, against one known intron: of those that overlap the one of the highest ``median_count``."""
    j = junctions.select("junction_id", "seqname", "start", "end", "strand")
    order = [F.coalesce(-F.col("b.median_count"), F.lit(float("inf"))), F.col("b.start"), F.col("b.end")]
    top = intervals.overlap(j, introns, width).groupBy(F.col("a.junction_id").alias("junction_id"), F.col("a.start").alias("s"), F.col("a.end").alias("e")).agg(F.min_by("b", F.struct(*order)).alias("b"))
    same_start, same_end = F.col("s") == F.col("b.start"), F.col("e") == F.col("b.end")
    label = F.when(same_start & same_end, "both").when(same_start, "start").when(same_end, "end").otherwise("none")
    return j.select("junction_id").join(top.select("junction_id", label.alias("annotated")), "junction_id", "left").withColumn("annotated", F.coalesce("annotated", F.lit("none")))


def end_windows(junctions: DataFrame, key: str = "junction_id", bases: int = 5) -> DataFrame:
    """The ``bases`` either side of both ends of each junction, as two ranges."""
    at = F.array(F.struct((F.col("start") - bases).alias("start"), (F.col("start") + bases - 1).alias("end")), F.struct((F.col("end") - bases + 1).alias("start"), (F.col("end") + bases).alias("end")))
    return junctions.select(key, "seqname", "strand", F.explode(at).alias("e")).select(key, "seqname", "strand", "e.start", "e.end")


def blacklisted(junctions: DataFrame, regions: DataFrame, width: int = 1000) -> DataFrame:
    """junction_id and whether the 10 bases around either end meet a region."""
    hit = intervals.overlap(end_windows(junctions), regions.withColumn("strand", F.lit("*")), width).select(F.col("a.junction_id").alias("junction_id")).distinct()
    return junctions.select("junction_id").join(hit.withColumn("blacklisted", F.lit(True)), "junction_id", "left").withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False)))


def utr_label(features: DataFrame, five: DataFrame, three: DataFrame, key: str, bases: int = 5, width: int = 1000) -> DataFrame:
    """key and utr: 5'-UTR before 3'-UTR before no, by the ``bases`` either side of both ends."""
    ends = end_windows(features, key, bases)
    out = features.select(key)
    for name, utr in (("five", five), ("three", three)):
        hit = intervals.overlap(ends, utr, width).select(F.col(f"a.{key}").alias(key)).distinct().withColumn(name, F.lit(True))
        out = out.join(hit, key, "left")
    return out.select(key, F.when(F.col("five"), "5'-UTR").when(F.col("three"), "3'-UTR").otherwise("no").alias("utr"))


def impact(results: DataFrame, intron_use: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """results with impact and frameshift, for junctions with ``annotated`` and ``delta``.

    ``intron_use``: known introns with the median count of their junction. A junction with a known start is judged
    against the most used known intron of that start, and so for the end: a shorter or longer far end shortens or lengthens the
    exon; beyond an exon it skips exons; without any known end it lies in an exon, between genes or is complex. Skipped exons and
    complex cases go beyond a gene if an end is in none, and join genes if the ends share none. With columns nonsplit_proportion,
    nonsplit_q99 and nonsplit_counts a known intron of reduced usage can be retained. Rows may repeat a junction, for each sample.
    """
    best = {k: intron_use.groupBy("seqname", k).agg(F.max_by(F.struct("start", "end"), F.struct("median_count", -F.col("start"), -F.col("end"))).alias(f"by_{k}")) for k in ("start", "end")}
    out = results.join(best["start"], ["seqname", "start"], "left").join(best["end"], ["seqname", "end"], "left")
    inside = intervals.overlap(results.select("junction_id", "seqname", "start", "end", "strand").distinct(), exons, 1000, kind="within").select(F.col("a.junction_id").alias("junction_id")).distinct().withColumn("in_exon", F.lit(True))
    whole = results.select("junction_id", "seqname", "start", "end", "strand").distinct()
    skipped = intervals.overlap(exons, whole, 1000, kind="within").groupBy(F.col("b.junction_id").alias("junction_id")).agg(F.count_distinct(F.struct("a.start", "a.end")).alias("skipped"), F.min(F.col("a.end") - F.col("a.start") + 1).alias("skipped_length"))
    near = intervals.nearest(whole, genes, "junction_id", "gene_id", stranded=True)
    in_gene = intervals.overlap(whole, genes, 5000).groupBy(F.col("a.junction_id").alias("junction_id")).agg(F.count_distinct("b.gene_id").alias("n_genes"))
    out = out.join(gene_ends(whole, genes), "junction_id", "left").join(inside, "junction_id", "left").join(skipped, "junction_id", "left").join(near, "junction_id", "left").join(in_gene, "junction_id", "left").join(genes.select(F.col("gene_id").alias("nearest"), F.col("start").alias("gene_start")), "nearest", "left")
    by_start, by_end = F.col("end") - F.col("by_start.end"), F.col("by_end.start") - F.col("start")
    shift = F.when(F.col("annotated") == "start", by_start).when(F.col("annotated") == "end", by_end)
    single = F.col("skipped") == 1
    beyond = ~F.coalesce("start_in_gene", F.lit(False)) | ~F.coalesce("end_in_gene", F.lit(False))
    across = lambda kept: F.when(F.coalesce("share_gene", F.lit(False)), kept).when(beyond, "splicingBeyondGene").otherwise("multigenicSplicing")
    retained = F.lit(False)
    if {"nonsplit_proportion", "nonsplit_q99", "nonsplit_counts"} <= set(results.columns):
        retained = F.coalesce((F.col("delta") < 0) & (F.col("nonsplit_proportion") >= F.col("nonsplit_q99") + 0.05) & (F.col("nonsplit_counts") >= 10), F.lit(False))
    upstream = (F.col("gene_start") > F.col("start")) == (F.col("strand") == "+")
    label = (
        F.when((F.col("annotated") == "both") & (F.col("delta") >= 0), "annotatedIntron_increasedUsage").when((F.col("annotated") == "both") & retained, "(partial)intronRetention").when(F.col("annotated") == "both", "annotatedIntron_reducedUsage")
        .when(F.coalesce(F.col("skipped"), F.lit(0)) > 0, across(F.when(single, "singleExonSkipping").otherwise("exonSkipping")))
        .when(F.col("annotated").isin("start", "end") & (shift > 0), "exonTruncation").when(F.col("annotated").isin("start", "end") & (shift < 0), "exonElongation")
        .when(F.col("in_exon"), "exonTruncation")
        .when(F.col("n_genes").isNull() & F.col("nearest").isNotNull(), F.when(upstream, "upstreamOfNearestGene").otherwise("downstreamOfNearestGene")).otherwise(across(F.lit("complex")))
    )
    moved = F.when(F.col("annotated") == "none", F.col("end") - F.col("start") + 1).otherwise(shift)
    frame = F.when(F.col("impact").startswith("annotatedIntron") | F.col("impact").endswith("OfNearestGene"), "unlikely").when(F.col("impact").isin("exonTruncation", "exonElongation"), F.when(moved % 3 == 0, "unlikely").otherwise("likely")).when(F.col("impact") == "singleExonSkipping", F.when(F.col("skipped_length") % 3 == 0, "unlikely").otherwise("likely")).otherwise("inconclusive")
    return out.withColumn("impact", label).withColumn("frameshift", frame).select(*results.columns, "impact", "frameshift", "distance")


def gene_ends(junctions: DataFrame, genes: DataFrame) -> DataFrame:
    """junction_id, and whether its start and its end meet or touch a gene, and both the same one; no row if neither does."""
    inner = F.when(F.col("start") + 2 < F.col("end"), 1).otherwise(0)
    j = junctions.withColumns({"_s": F.col("start") + inner, "_e": F.col("end") - inner})
    # two bases at each end, and one more on both sides as touching genes count
    at = F.array(F.struct(F.lit(True).alias("first"), (F.col("_s") - 1).alias("s"), (F.col("_s") + 2).alias("e")), F.struct(F.lit(False).alias("first"), (F.col("_e") - 2).alias("s"), (F.col("_e") + 1).alias("e")))
    ends = j.select("junction_id", "seqname", "strand", F.explode(at).alias("x")).select("junction_id", "seqname", "strand", "x.first", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    by_gene = intervals.overlap(ends, genes, 5000).groupBy(F.col("a.junction_id").alias("junction_id"), "b.gene_id").agg(F.bool_or("a.first").alias("s"), F.bool_or(~F.col("a.first")).alias("e"))
    return by_gene.groupBy("junction_id").agg(F.bool_or("s").alias("start_in_gene"), F.bool_or("e").alias("end_in_gene"), F.bool_or(F.col("s") & F.col("e")).alias("share_gene"))


def theta_impact(sites: DataFrame, introns: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """sites with impact and distance: exonicRegion, annotatedSpliceSite, intronicRegion, up- or downstream of the nearest gene, or NULL within a gene."""
    key = F.col("a.site_id").alias("site_id")
    at = sites.select("site_id", "seqname", "start", "end", "strand").distinct()
    inside = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    exonic = intervals.overlap(at, exons).groupBy(key).agg(F.bool_and(inside).alias("whole"))
    intronic = intervals.overlap(at, introns, 5000).select(key).distinct().withColumn("intronic", F.lit(True))
    in_gene = intervals.overlap(at, genes, 5000).select(key).distinct().withColumn("in_gene", F.lit(True))
    near = intervals.nearest(at, genes, "site_id", "gene_id", stranded=True).join(genes.select(F.col("gene_id").alias("nearest"), F.col("start").alias("gene_start")), "nearest", "left")
    out = sites.join(exonic, "site_id", "left").join(intronic, "site_id", "left").join(in_gene, "site_id", "left").join(near, "site_id", "left")
    upstream = (F.col("gene_start") > F.col("start")) == (F.col("strand") == "+")
    label = F.when(F.col("whole"), "exonicRegion").when(~F.col("whole"), "annotatedSpliceSite").when(F.col("intronic"), "intronicRegion").when(F.col("in_gene").isNull() & F.col("nearest").isNotNull(), F.when(upstream, "upstreamOfNearestGene").otherwise("downstreamOfNearestGene"))
    return out.withColumn("impact", label).select(*sites.columns, "impact", "distance")
