"""What an unknown junction does to the exons at its ends, compared with the most used known intron there.

A junction that shares one end with known introns is compared at the other end; one that shares none is compared at both, with the most used intron that it
overlaps. At an end it lengthens an exon or shortens one, or it skips the exon that follows: one exon if no other lies before it and the most
used intron behind it leads on without a further exon. Left ends are right ends of mirrored coordinates, so both sides are one chain of equi-joins and range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import shared
from . import intervals

RANGE = ["seqname", "start", "end", "strand"]


def _both_sides(df: DataFrame) -> DataFrame:
    """``df`` as it is, on sequences named for right ends, and mirrored, on those for left ends."""
    right = df.withColumn("seqname", F.concat(F.lit("right "), "seqname"))
    left = df.withColumns({"seqname": F.concat(F.lit("left "), "seqname"), "start": -F.col("end"), "end": -F.col("start")})
    return right.unionByName(left)


def _most_used(order: str = "b") -> Column:
    return F.struct(F.coalesce(-F.col(f"{order}.median_count"), F.lit(float("inf"))), F.col(f"{order}.start"), F.col(f"{order}.end"))


def compared_introns(junctions: DataFrame, introns: DataFrame, width: int = 5000) -> DataFrame:
    """junction_id, range, annotated, and the ends of the most used intron that a junction is compared with; NULL where a junction without a known end overlaps none."""
    j = junctions.select("junction_id", *RANGE, "annotated").distinct().filter("annotated in ('start', 'end', 'none')")
    known = introns.select(*RANGE, "median_count")
    pairs = None
    for kind in ("start", "end", "any"):
        own = j.filter(F.col("annotated") == ("none" if kind == "any" else kind))
        met = intervals.overlap(own, known, width, kind=kind)
        pairs = met if pairs is None else pairs.unionByName(met)
    top = pairs.groupBy(F.col("a.junction_id").alias("junction_id")).agg(F.min_by("b", _most_used()).alias("b"))
    return j.join(top, "junction_id", "left").select("junction_id", *RANGE, "annotated", F.col("b.start").alias("intron_start"), F.col("b.end").alias("intron_end"))


def end_effects(compared: DataFrame, introns: DataFrame, exons: DataFrame, width: int = 1000) -> DataFrame:
    """junction_id, side (left or right), effect and shift, the bases that the exons gain or, below 0, lose; 0 for effects whose bases are not known."""
    sides = F.when(F.col("annotated") == "start", F.array(F.lit("right"))).when(F.col("annotated") == "end", F.array(F.lit("left"))).otherwise(F.array(F.lit("right"), F.lit("left")))
    j = compared.filter("intron_end is not null").withColumn("side", F.explode(sides))
    turned = F.col("side") == "left"
    j = j.select(
        "junction_id", "side", F.concat("side", F.lit(" "), "seqname").alias("seqname"), "strand",
        F.when(turned, -F.col("end")).otherwise(F.col("start")).alias("start"), F.when(turned, -F.col("start")).otherwise(F.col("end")).alias("end"), F.when(turned, -F.col("intron_start")).otherwise(F.col("intron_end")).alias("far"),
    )
    key = ["junction_id", "side"]
    exons, introns = shared.written(_both_sides(exons.select(*RANGE).distinct()), "exon-sides"), shared.written(_both_sides(introns.select(*RANGE, "median_count")), "intron-sides")
    matches = lambda other: (F.col("strand") == F.col(other)) | (F.col("strand") == "*") | (F.col(other) == "*")
    # exons that begin where the intron ends
    e = exons.select(F.col("seqname").alias("_seq"), (F.col("start") - 1).alias("_far"), F.col("end").alias("exon_end"), F.col("strand").alias("_strand"))
    following = j.filter("far < end").join(e, (F.col("seqname") == F.col("_seq")) & (F.col("far") == F.col("_far")) & matches("_strand"))
    following = following.groupBy(*key).agg(F.max("exon_end").alias("exon_end"), F.count_distinct("exon_end", "_strand").alias("n_exons"))
    j = shared.written(j.join(following, key, "left"), "ends")
    single = j.filter((F.col("n_exons") == 1) & (F.col("exon_end") < F.col("end")))
    # exons before the one that is skipped
    before = single.select(*key, "seqname", "start", F.col("far").alias("end"), "strand").filter("start <= end")
    crowded = intervals.overlap(exons, before, width, kind="within").select("b.junction_id", "b.side").distinct().withColumn("crowded", F.lit(True))
    # the most used intron that begins behind it, and exons inside of that
    i = introns.select(F.col("seqname").alias("_seq"), F.col("start").alias("_start"), F.col("end").alias("next_end"), F.col("strand").alias("_strand"), "median_count")
    after = single.join(i, (F.col("seqname") == F.col("_seq")) & (F.col("exon_end") + 1 == F.col("_start")) & matches("_strand"))
    after = after.groupBy(*key, "seqname", "exon_end").agg(F.min_by(F.struct("next_end", "_strand"), F.struct(F.coalesce(-F.col("median_count"), F.lit(float("inf"))), "next_end")).alias("n"))
    after = shared.written(after.select(*key, "seqname", (F.col("exon_end") + 1).alias("start"), F.col("n.next_end").alias("end"), F.col("n._strand").alias("strand")), "next-introns")
    inside = intervals.overlap(exons, after, width, kind="within").select("b.junction_id", "b.side").distinct().withColumn("further", F.lit(True))
    out = j.join(crowded, key, "left").join(after.select(*key, F.col("end").alias("next_end")), key, "left").join(inside, key, "left")
    skips = (F.col("n_exons") == 1) & F.col("crowded").isNull() & F.col("further").isNull() & (F.col("end") <= F.col("next_end"))
    effect = F.when(F.col("far") > F.col("end"), "exonElongation").when(F.col("exon_end") > F.col("end"), "exonTruncation").when(F.coalesce(skips, F.lit(False)), "singleExonSkipping").otherwise("exonSkipping")
    out = out.withColumn("effect", effect)
    shift = (
        F.when(F.col("effect") == "exonElongation", F.col("far") - F.col("end")).when(F.col("effect") == "exonTruncation", F.col("far") - F.col("end"))
        .when(F.col("effect") == "singleExonSkipping", F.col("far") - F.col("exon_end") + F.col("next_end") - F.col("end")).otherwise(0)
    )
    return out.select(*key, "effect", shift.cast("long").alias("shift"))


def chain_impact(junctions: DataFrame, introns: DataFrame, exons: DataFrame, width: int = 5000) -> DataFrame:
    """junction_id, effect and frameshift of junctions without both ends of a known intron.

    ``junctions``: junction_id, range and annotated; ``introns``: known ones with median_count. Effects of both ends are one if they are alike, exonTruncation&Elongation if
    one is each, and skipping wins; a single skipped exon keeps its frame by the bases of both ends. noOverlap: no known intron to compare with.
    """
    with shared.scratch():
        introns = shared.written(introns.select(*RANGE, "median_count"), "introns")
        compared = shared.written(compared_introns(junctions, introns, width), "compared")
        return shared.written(_merged(compared, end_effects(compared, introns, exons)), "chain-impact", keep=True)


def _merged(compared: DataFrame, effects: DataFrame) -> DataFrame:
    wide = effects.groupBy("junction_id").agg(F.sort_array(F.collect_list(F.struct("effect", "shift"))).alias("x"))
    out = compared.select("junction_id").join(wide, "junction_id", "left")
    first, second, total = F.col("x")[0]["effect"], F.get("x", F.lit(1))["effect"], F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v["shift"])
    frame = F.when(total % 3 == 0, "unlikely").otherwise("likely")
    one = F.when(F.size("x") == 1, F.struct(first.alias("effect"), F.when(first == "exonSkipping", "inconclusive").otherwise(frame).alias("frameshift")))
    unclear = F.struct(F.lit("exonSkipping").alias("effect"), F.lit("inconclusive").alias("frameshift"))
    # sorted, so elongation and truncation come before single skipping
    both = (
        F.when((first == "exonSkipping") | (second == "exonSkipping") | ((first == "singleExonSkipping") & (second == "singleExonSkipping")), unclear)
        .when(second == "singleExonSkipping", F.struct(second.alias("effect"), frame.alias("frameshift")))
        .otherwise(F.struct(F.when(first == second, first).otherwise("exonTruncation&Elongation").alias("effect"), frame.alias("frameshift")))
    )
    none = F.struct(F.lit("noOverlap").alias("effect"), F.lit("inconclusive").alias("frameshift"))
    return out.withColumn("r", F.when(F.col("x").isNull(), none).otherwise(F.coalesce(one, both))).select("junction_id", "r.effect", "r.frameshift")
