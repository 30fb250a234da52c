"""Counting from alignments, against counts made by hand, and external counts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from junctura.operators import counting

ALIGNMENTS = "read_id string, sample_id string, seqname string, pos int, cigar string, strand string, mate int, mapq int"


def frame(spark, rows):
    return spark.createDataFrame(rows, ALIGNMENTS)


@pytest.fixture(scope="module")
def reads(spark):
    rows = [("p1", "s", "chr1", 101, "10M100N10M", "+", 1, 60), ("p1", "s", "chr1", 106, "5M100N20M", "-", 2, 60), ("p2", "s", "chr1", 101, "10M100N10M", "-", 1, 5), ("p3", "s", "chr1", 91, "3S30M2I5M", "+", 1, 60)]
    rows += [("p4", "t", "chr2", 50, "10M20N5M1D4M30N10M", "+", 1, 60), ("p5", "t", "chr1", 205, "40M", "+", 1, 60)]
    return frame(spark, rows)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_pairs_count_once_and_single_reads_one_by_one(reads):
    want = {("s", "chr1", 111, 210, "*", 2), ("t", "chr2", 60, 79, "*", 1), ("t", "chr2", 90, 119, "*", 1)}
    assert as_set(counting.split_counts(reads)) == want
    assert ("s", "chr1", 111, 210, "*", 3) in as_set(counting.split_counts(reads, paired=False))


def test_strand_follows_the_first_mate_or_its_opposite(reads):
    forward = as_set(counting.split_counts(reads, counting.FORWARD).filter("seqname = 'chr1'"))
    assert forward == {("s", "chr1", 111, 210, "+", 1), ("s", "chr1", 111, 210, "-", 1)}
    assert ("t", "chr2", 60, 79, "-", 1) in as_set(counting.split_counts(reads, counting.REVERSE))


def test_restriction_and_expression(reads):
    few = counting.restricted(reads, ["chr1"], 10)
    assert as_set(counting.split_counts(few)) == {("s", "chr1", 111, 210, "*", 1)}
    assert as_set(counting.expressed(counting.split_counts(reads), 2)) == {("chr1", 111, 210, "*")}


def test_blocks_leave_introns_out(reads):
    got = as_set(counting.alignment_blocks(reads.filter("read_id = 'p4'")).select("start", "end"))
    assert got == {(50, 59), (80, 89), (120, 129)}
    assert as_set(counting.alignment_blocks(reads.filter("read_id = 'p3'")).select("start", "end")) == {(91, 125)}


def test_sites_have_sides_by_strand(spark):
    j = spark.createDataFrame([("chr1", 111, 210, "+"), ("chr1", 111, 210, "-"), ("chr1", 111, 300, "+")], "seqname string, start int, end int, strand string")
    got = as_set(counting.site_coordinates(j))
    assert ("chr1", 110, 111, "+", "Donor") in got and ("chr1", 210, 211, "-", "Donor") in got and ("chr1", 300, 301, "+", "Acceptor") in got and len(got) == 5
    ids = counting.with_site_ids(j)
    assert ids.select("start_id").distinct().count() == 2 and ids.select("junction_id").distinct().count() == 3


def test_nonsplit_reads_need_both_sides_of_a_site(spark, reads):
    ds = counting.count_dataset(reads, reads.select("sample_id").distinct(), min_expression=None)
    at = {(r.site_id, r.sample_id): r.k for r in ds.ss_counts.collect()}
    # p3 covers 91 to 125 around the site 110-111, p5 covers 205 to 244 around 210-211; spanning reads have one side only
    assert at == {("chr1:110-111:*", "s"): 1, ("chr1:210-211:*", "t"): 1}
    assert ds.checked() is ds and ds.junctions.count() == 3


def test_mates_that_overlap_count_their_bases_once(spark):
    two = frame(spark, [("a", "s", "chr1", 100, "6M", "+", 1, 60), ("a", "s", "chr1", 100, "6M", "-", 2, 60), ("b", "s", "chr1", 100, "6M", "+", 1, 60), ("b", "s", "chr1", 104, "8M", "-", 2, 60)])
    site = spark.createDataFrame([("x", "chr1", 105, 106, "*")], "site_id string, seqname string, start int, end int, strand string")
    assert as_set(counting.nonsplit_counts(two, site)) == {("x", "s", 1)}


def test_motifs_give_strands(spark, reads):
    motifs = spark.createDataFrame([("chr1", 111, 210, "-")], "seqname string, start int, end int, strand string")
    got = {(r.seqname, r.start): r.strand for r in counting.with_motif_strand(counting.split_counts(reads), motifs).collect()}
    assert got == {("chr1", 111): "-", ("chr2", 60): "+", ("chr2", 90): "+"}


def test_external_counts_must_be_complete(spark, sf_dir):
    from junctura.sources.cohort import cohort

    ds = cohort(spark, sf_dir)
    with pytest.raises(ValueError, match="missing"):
        counting.merge_external(ds, {"k_j": ds.j_counts}, ds.samples)


def test_chromosome_names(spark):
    names = spark.createDataFrame([("chr1",), ("chr2",), ("X",)], "seqname string")
    assert counting.common_chromosome_style(names).first().style == "UCSC"
    lengths = spark.createDataFrame([("a", 5), ("a", 5), ("b", 1), ("b", 2)], "seqname string, length int")
    assert as_set(counting.uniform_chromosomes(lengths)) == {("a", 5)}
    assert counting.mapped_chromosomes(frame(spark, [])).count() == 0
    assert F is not None


def test_unpaired_reads_count_one_by_one_at_sites(spark):
    site = spark.createDataFrame([("x", "chr1", 105, 106, "*"), ("y", "chr1", 118, 119, "*")], "site_id string, seqname string, start int, end int, strand string")
    rows = [("a", "s", "chr1", 95, "30M", "+", 1, 60)] * 2 + [("a", "s", "chr1", 96, "30M", "+", 1, 60), ("b", "s", "chr1", 100, "6M2N6M", "+", 1, 60), ("c", "s", "chr1", 100, "8M2N30M", "-", 1, 60), ("d", "t", "chr1", 50, "20M10N40M5N10M1000N30M", "+", 1, 60), (None, "t", "chr1", 90, "40M", "+", 1, 60)]
    reads = frame(spark, rows)
    # b has six and four bases around x, c eight and two; the repeated row counts twice, one name three times
    assert as_set(counting.nonsplit_counts(reads, site, paired=False)) == {("x", "s", 5), ("x", "t", 2), ("y", "s", 4), ("y", "t", 1)}
    assert as_set(counting.nonsplit_counts(reads, site)) == {("x", "s", 3), ("x", "t", 2), ("y", "s", 2), ("y", "t", 1)}
    both = site.withColumn("type", F.explode(F.array(F.lit("Donor"), F.lit("Acceptor"))))
    assert as_set(counting.nonsplit_counts(reads, both, paired=False)) == {("x", "s", 5), ("x", "t", 2), ("y", "s", 4), ("y", "t", 1)}
    without = counting.nonsplit_counts(reads.drop("mate", "mapq"), site, paired=False)
    assert as_set(without) == {("x", "s", 5), ("x", "t", 2), ("y", "s", 4), ("y", "t", 1)}


def test_a_long_read_of_many_introns(spark):
    """Two thousand introns, in time that grows with the CIGAR."""
    cigar = "30M70N" * 2000 + "30M"
    reads = spark.createDataFrame([("r", "s", "chr1", 1, cigar, "+")], "read_id string, sample_id string, seqname string, pos int, cigar string, strand string")
    ds = counting.count_dataset(reads, reads.select("sample_id"), paired=False, min_expression=1)
    assert ds.j_counts.count() == 2000 and ds.ss_counts.count() == 0
    inside = spark.createDataFrame([(str(i), "chr1", 100 * i + 15, 100 * i + 16, "*") for i in range(0, 2001, 400)], "site_id string, seqname string, start int, end int, strand string")
    assert as_set(counting.nonsplit_counts(reads, inside, paired=False)) == {(str(i), "s", 1) for i in range(0, 2001, 400)}


def joined_rows(df, what="Join"):
    """The rows that the joins of a plan (or other operators) have made, read from its metrics after it has run."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("numOutputRows") if what in kind else None
        return (own.get().value() if own is not None and own.isDefined() else 0) + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("paired", [False, True])
def test_reads_that_look_alike_meet_a_site_once(spark, paired):
    """What is joined and shuffled further grows with the looks of fragments, not with their number."""
    reads = spark.range(20_000).select(F.col("id").alias("read_id"), F.lit("s").alias("sample_id"), F.lit("chr1").alias("seqname"), (100 + F.col("id") % 4).cast("int").alias("pos"), F.lit("30M100N30M").alias("cigar"), F.lit("+").alias("strand"))
    sites = spark.createDataFrame([("x", "chr1", 112, 113, "*"), ("y", "chr1", 250, 251, "*")], "site_id string, seqname string, start int, end int, strand string")
    counts = counting.nonsplit_counts(reads, sites, paired=paired)
    assert as_set(counts) == {("x", "s", 20_000), ("y", "s", 20_000)}
    assert joined_rows(counts) < 100


@pytest.mark.parametrize("paired", [False, True])
def test_introns_of_reads_that_look_alike_are_taken_once(spark, paired):
    reads = spark.range(20_000).select(F.col("id").alias("read_id"), F.lit("s").alias("sample_id"), F.lit("chr1").alias("seqname"), F.lit(100).alias("pos"), F.lit("30M100N30M").alias("cigar"), F.lit("+").alias("strand"))
    counts = counting.split_counts(reads, paired=paired)
    assert as_set(counts) == {("s", "chr1", 130, 229, "*", 20_000)}
    assert 0 < joined_rows(counts, "Generate") < 100


def test_a_dataset_reads_its_alignments_once(spark, tmp_path):
    path = f"{tmp_path}/reads"
    spark.createDataFrame([(f"r{i}", "s", "chr1", 100, cigar, "+") for i in range(25) for cigar in ("20M50N20M",)] + [("n", "s", "chr1", 105, "40M", "+")], "read_id string, sample_id string, seqname string, pos int, cigar string, strand string").write.parquet(path)
    reads = spark.read.parquet(path)
    ds = counting.count_dataset(reads, reads.select("sample_id").distinct())
    assert as_set(ds.j_counts) == {("chr1:120-169:*", "s", 25)} and as_set(ds.ss_counts) == {("chr1:119-120:*", "s", 1)}
    assert not [f for t in (ds.j_counts, ds.junctions, ds.sites, ds.ss_counts) for f in t.inputFiles() if path in f]


def covered(pos, cigar):
    bases, introns = set(), []
    for n, kind in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        if kind in "MDN=X":
            if kind == "N":
                introns.append((pos, pos + int(n) - 1))
            else:
                bases |= set(range(pos, pos + int(n)))
            pos += int(n)
    return bases, introns


@pytest.mark.parametrize(("mode", "paired"), [(counting.UNSTRANDED, True), (counting.UNSTRANDED, False), (counting.FORWARD, True), (counting.REVERSE, False)])
def test_random_reads_against_plain_counts(spark, mode, paired):
    rng = random.Random(7)
    cigars = ["12M", "30M", "8M3N9M", "6M11N7M", "6M10N7M", "5M12N6M40N20M", "3S9M2I4D6M", "700M", "4M1N2M1N3M1N8M", "6=2X250N15M", "*", "10M0N10M", None]
    rows = [(rng.choice([*(f"r{i}" for i in range(60)), None]), rng.choice("st"), rng.choice(["chr1", "chr2"]), rng.choice([None, *range(80, 200)]), rng.choice(cigars), rng.choice("+-"), rng.choice([1, 2]), 60) for _ in range(400)]
    places = [(f"{c}{a}{s}{w}", c, a, a + w, s) for c in ("chr1", "chr2") for a in range(70, 460, 13) for s, w in (("*", 1), ("+", 1), ("-", 1), ("*", 40))]
    split, nonsplit, groups = defaultdict(list), Counter(), defaultdict(list)
    for i, (read, sample, seq, pos, cigar, strand, mate, _) in enumerate(rows):
        if pos is None or cigar is None:
            continue
        turned = (mate == 2) != (mode == counting.REVERSE)
        own = "*" if mode == counting.UNSTRANDED else {"+": "-", "-": "+"}[strand] if turned else strand
        bases, introns = covered(pos, cigar)
        groups[(sample, seq, read if paired else i)].append((own, bases))
        for j in introns:
            split[(sample, seq, *j, own)].append(read if paired else i)
    for (sample, seq, _), parts in groups.items():
        for site, c, a, b, s in places:
            if c == seq and len(set().union(*[x for own, x in parts if "*" in (own, s) or own == s]) & set(range(a - 5, b + 6))) >= 10:
                nonsplit[(site, sample)] += 1
    reads = frame(spark, rows)
    want = {(*k, len({r for r in v if r is not None})) for k, v in split.items()} if paired else {(*k, len(v)) for k, v in split.items()}
    assert as_set(counting.split_counts(reads, mode, paired)) == want
    sites = spark.createDataFrame(places, "site_id string, seqname string, start int, end int, strand string")
    got = counting.nonsplit_counts(reads, sites, strand_mode=mode, paired=paired).collect()
    assert {(r.site_id, r.sample_id): r.k for r in got} == dict(nonsplit) and len(got) == len(nonsplit)
