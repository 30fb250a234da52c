"""Alignment files, counts kept by sample, sequences and nested bins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators import counting, intervals, padjust
from junctura.sources import bam, increments, sequence

ALIGNMENTS = "read_id string, sample_id string, seqname string, pos int, cigar string, strand string, mate int, mapq int"
REFERENCES = [("chr1", 3_000_000), ("chr2", 900_000), ("empty", 10)]


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        cigar = rng.choice(["50M", "20M1000N30M", "5S20M200000N25M", "10M2I5M3D10M50N9M", "30M5000N10M7N10M"])
        rows.append((f"r{i // 2}", rng.choice("ab"), rng.choice(["chr1", "chr1", "chr2"]), rng.randint(1, 600_000), cigar, rng.choice("+-"), rng.choice([1, 2, None]), rng.choice([0, 5, 60, None])))
    return spark.createDataFrame(rows, ALIGNMENTS)


@pytest.fixture(scope="module")
def folder(spark, reads, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "files")
    bam.write_alignments(reads.repartition(4), path, REFERENCES)
    return path


def test_files_hold_what_was_written(spark, reads, folder):
    back = bam.read_alignments(spark, folder, split=1).drop("flag").select(*reads.columns)
    assert rows_of(back) == rows_of(reads)
    whole = bam.read_alignments(spark, f"file://{folder}").drop("flag").select(*reads.columns)
    assert rows_of(whole) == rows_of(reads)


@pytest.mark.parametrize("split", [1, 1 << 25])
def test_regions_are_those_that_overlap(spark, reads, folder, split):
    regions = [("chr1", 100_000, 120_000), ("chr1", 119_000, 150_500), ("chr2", 1, 40), ("empty", 1, 5), ("chrX", 1, 9)]
    span = F.expr("aggregate(transform(regexp_extract_all(cigar, '(\\\\d+[MDN])', 1), x -> int(rtrim('MDN', x))), 0, (a, x) -> a + x)")
    inside = F.lit(False)
    for name, low, high in regions:
        inside |= (F.col("seqname") == name) & (F.col("pos") <= high) & (F.col("pos") + F.col("span") - 1 >= low)
    want = reads.withColumn("span", span).filter(inside).drop("span")
    got = bam.read_alignments(spark, folder, regions=regions, split=split)
    assert rows_of(got.select(*reads.columns)) == rows_of(want) and want.count() > 100


def test_the_index_keeps_stretches_apart(spark, reads, folder):
    reader = bam.BamReader({"path": folder, "regions": '[["chr2", 500000, 501000]]'})
    few, all_ = reader.partitions(), bam.BamReader({"path": folder, "splitbytes": "1"}).partitions()
    assert 0 < len(few) < len(all_)
    by_file = {}
    for s in all_:
        by_file.setdefault(s.path, []).append((s.begin, s.end))
    for stretches in by_file.values():
        stretches.sort()
        assert all(a < b for a, b in stretches) and all(x[1] <= y[0] for x, y in itertools.pairwise(stretches))


def test_filters_reach_the_reader(spark, reads, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        q = bam.read_alignments(spark, folder).filter("seqname = 'chr2' and mapq > 5 and sample_id in ('a', 'c')")
        assert rows_of(q.select(*reads.columns)) == rows_of(reads.filter("seqname = 'chr2' and mapq > 5 and sample_id in ('a', 'c')"))
        assert "chr2" not in q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_without_index_and_leftovers(spark, reads, folder, tmp_path):
    import pathlib
    import shutil

    shutil.copytree(folder, tmp_path / "copy")
    for f in (tmp_path / "copy").glob("*.bai"):
        f.unlink()
    (tmp_path / "copy" / "left.bam").write_bytes(b"what a failed task left")
    got = bam.read_alignments(spark, str(tmp_path / "copy"), chromosomes=["chr2"], min_mapq=5)
    assert rows_of(got.select(*reads.columns)) == rows_of(reads.filter("seqname = 'chr2' and coalesce(mapq, 255) >= 5"))
    one = next(iter(sorted(pathlib.Path(folder).glob("*.bam"))))
    assert 0 < bam.read_alignments(spark, str(one)).count() < reads.count()
    bam.write_alignments(reads.limit(0), str(tmp_path / "none"), REFERENCES)
    assert bam.read_alignments(spark, str(tmp_path / "none")).count() == 0
    bam.write_alignments(reads, str(tmp_path / "none"), REFERENCES, mode="append")
    assert bam.read_alignments(spark, str(tmp_path / "none")).count() == reads.count()


def test_bins_are_nested():
    assert bam.bin_of(0, 1) == 4681 and bam.bin_of(0, 1 << 14) == 4681 and bam.bin_of(0, (1 << 14) + 1) == 585 and bam.bin_of(1 << 26, (1 << 26) + 1) == 4681 + (1 << 12) and bam.bin_of(0, 1 << 29) == 0
    assert all(bam.bin_of(a, b) in set(bam.bins_over(a, b)) for a, b in [(0, 5), (16_000, 17_000), (5_000_000, 90_000_000)])


def test_proper_pairs(spark):
    rows = [("p", "s", "chr1", 1, "9M", "+", 1, 9), ("p", "s", "chr1", 5, "9M", "-", 2, 9), ("p", "t", "chr1", 5, "9M", "-", 2, 9), ("q", "s", "chr1", 5, "9M", "-", 1, 9), ("q", "s", "chr2", 5, "9M", "-", 2, 9), ("u", "s", "chr2", 5, "9M", "-", None, 9)]
    assert {(r.read_id, r.mate) for r in counting.proper_pairs(spark.createDataFrame(rows, ALIGNMENTS)).collect()} == {("p", 1), ("p", 2)}


# --- counts kept by sample ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    rows = []
    for s in "abc":
        for i in range(400):
            at = rng.choice([1000, 3000] if s != "c" else [1000, 3000, 7000])
            rows.append((f"{s}{i}", s, rng.choice(["chr1", "chr2"]), at - rng.randint(1, 20), rng.choice(["20M100N20M", "40M", "30M"]), "+", 1, 60))
    return spark.createDataFrame(rows, ALIGNMENTS)


def counted(ds):
    return rows_of(ds.j_counts.select("junction_id", "sample_id", "k")), rows_of(ds.ss_counts.select("site_id", "sample_id", "k"))


def test_new_samples_are_added_to_what_is_kept(spark, small, tmp_path):
    path, asked = str(tmp_path / "counts"), []
    inner = increments.table_reader(small)

    def reader(samples, regions=None):
        asked.append((sorted(samples), regions))
        return inner(samples, regions)

    all_ = small.select("sample_id").distinct()
    two = all_.filter("sample_id <> 'c'")
    whole = lambda s: counted(counting.count_dataset(small.join(s, "sample_id", "left_semi"), s, min_expression=3))
    assert counted(increments.count_samples(spark, reader, two, path, min_expression=3)) == whole(two)
    assert asked == [(["a", "b"], None), (["a", "b"], None)]
    asked.clear()
    assert counted(increments.count_samples(spark, reader, two, path, min_expression=3)) == whole(two) and asked == []
    assert counted(increments.count_samples(spark, reader, all_, path, min_expression=3)) == whole(all_)
    # the new sample is read whole, the others around sites that it has brought
    assert (["c"], None) in asked and all(regions is not None for s, regions in asked if s != ["c"])
    asked.clear()
    assert counted(increments.count_samples(spark, reader, all_, path, min_expression=3, recount=["a"])) == whole(all_)
    assert {tuple(s) for s, _ in asked} == {("a",)}
    assert counted(increments.count_samples(spark, reader, all_, path, min_expression=3)) == whole(all_)
    increments.forget_samples(spark, path)
    asked.clear()
    increments.count_samples(spark, reader, two, path, min_expression=3)
    assert asked


def test_new_samples_are_read_once_for_both_kinds_of_counts(spark, small, tmp_path):
    """As often as a row's name is taken from the table, so often the table is read."""
    reads = spark.sparkContext.accumulator(0)

    def seen(name):
        reads.add(1)
        return name

    watched = small.withColumn("read_id", F.udf(seen, "string")("read_id"))
    two = small.select("sample_id").distinct().filter("sample_id <> 'c'")
    got = counted(increments.count_samples(spark, increments.table_reader(watched), two, str(tmp_path / "counts"), min_expression=3))
    assert reads.value == small.filter("sample_id <> 'c'").count()
    assert got == counted(counting.count_dataset(small.join(two, "sample_id", "left_semi"), two, min_expression=3))


def test_increments_from_files(spark, small, tmp_path):
    bam.write_alignments(small, str(tmp_path / "bam"), REFERENCES)
    reader, path = increments.file_reader(spark, str(tmp_path / "bam")), str(tmp_path / "counts")
    all_ = small.select("sample_id").distinct()
    increments.count_samples(spark, reader, all_.filter("sample_id = 'b'"), path, min_expression=3)
    got = counted(increments.count_samples(spark, reader, all_, path, min_expression=3))
    assert got == counted(counting.count_dataset(small, all_, min_expression=3))


# --- sequences --------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [50, 100_000])
def test_sequences_of_any_layout(spark, tmp_path, split):
    rng = random.Random(split)
    seqs = {n: "".join(rng.choice("ACGTNacgt") for _ in range(size)) for n, size in (("s1", 777), ("s2", 1), ("s3", 0), ("s4", 2500), ("s5", 40))}
    (tmp_path / "fa").mkdir()
    wrap = lambda s, w: "\n".join(s[i : i + w] for i in range(0, len(s), w))
    (tmp_path / "fa" / "a.fa").write_text("".join(f">{n} some words\n{wrap(seqs[n], 60)}\n" for n in ("s1", "s2", "s3")))
    (tmp_path / "fa" / "b.fa").write_text(f">s4\r\n{seqs['s4']}\r\n; a comment\n\n>s5 x\n{wrap(seqs['s5'], 7)}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        chunks = sequence.read_fasta(spark, str(tmp_path / "fa"), 100, 10)
        got = {(r.seqname, r.chunk): r.bases for r in chunks.collect()}
        want = {(n, c): s[100 * c : 100 * c + 110].upper() for n, s in seqs.items() for c in range(-(-len(s) // 100))}
        assert got == want
        places = [(n, at) for n in seqs for at in (0, 1, 39, 40, 95, 99, 100, 101, 776, 2499)]
        found = sequence.with_bases(spark.createDataFrame(places, "seqname string, at int"), chunks, F.col("at"), 3, chunk=100, overlap=10)
        assert {(r.seqname, r["at"]): r.bases for r in found.collect()} == {(n, at): seqs[n][at - 1 : at + 2].upper() if 0 < at <= len(seqs[n]) - 2 else None for n, at in places}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_motifs_of_both_strands(spark):
    table = sequence.motif_table()
    assert table["GT-AG"] == "+" and table["CT-AC"] == "-" and table["CT-GC"] == "-" and table["GT-AT"] == "-" and len(table) == 10
    chunks = spark.createDataFrame([("c", 0, "AAGTCCCAGTTCTGGGACTT")], "seqname string, chunk long, bases string")
    j = spark.createDataFrame([("c", 3, 9), ("c", 12, 18), ("c", 1, 5), ("c", 3, 90)], "seqname string, start int, end int")
    got = {(r.start, r.end): (r.motif, r.strand) for r in sequence.intron_motifs(j, chunks).collect()}
    assert got == {(3, 9): ("GT-AG", "+"), (12, 18): ("CT-AC", "-"), (1, 5): ("AA-TC", "*"), (3, 90): (None, "*")}


# --- nested bins ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("kind", "gap", "width"), [("any", 0, 100), ("any", 7, 50), ("within", 0, 10)])
def test_ranges_of_all_lengths(spark, kind, gap, width):
    rng = random.Random(gap + width)

    def some(n, name):
        out = []
        for i in range(n):
            start, size = rng.randint(1, 3_000_000), rng.choice([1, 5, 90, 101, 2000, 30_000, 1_000_000])
            out.append((f"{name}{i}", rng.choice(["c1", "c2"]), start, start + size - 1, rng.choice("+-*")))
        return out

    a, b = some(150, "a"), some(150, "b")
    schema = "id string, seqname string, start int, end int, strand string"
    pairs = intervals.overlap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width, kind=kind, gap=gap)
    got = [(r.x, r.y) for r in pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()]
    meets = lambda x, y: x[1] == y[1] and (x[4] == y[4] or "*" in (x[4], y[4])) and min(x[3], y[3]) - max(x[2], y[2]) + 1 >= 1 - gap and (kind == "any" or y[2] <= x[2] and x[3] <= y[3])
    want = {(x[0], y[0]) for x in a for y in b if meets(x, y)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_long_ranges_make_few_rows(spark):
    a = spark.createDataFrame([("x", "c", 1, 10**8, "*")], "id string, seqname string, start int, end int, strand string")
    b = spark.createDataFrame([(f"y{i}", "c", i * 10**6 + 1, i * 10**6 + 50, "*") for i in range(90)], "id string, seqname string, start int, end int, strand string")
    left, right = intervals._resting(a, 100), intervals._resting(b, 100)
    assert intervals._bins(left, F.col("_rest"), 100).count() <= 2 and intervals._visiting(right, left, 100, 0, 1).groupBy("id").count().agg(F.max("count")).first()[0] <= 2
    assert intervals.overlap(a, b, 100).count() == intervals.overlap(b, a, 100).count() == 90


# --- Hommel -----------------------------------------------------------------------------------------


def plain_hommel(p):
    """The largest Simes p-value of all sets that have the hypothesis."""
    simes = lambda s: min(len(s) * x / (i + 1) for i, x in enumerate(sorted(s)))
    return [max(simes([p[j] for j in range(len(p)) if j == i or mask >> j & 1]) for mask in range(1 << len(p))) for i in range(len(p))]


@pytest.mark.parametrize("seed", range(12))
def test_hommel_is_closed_testing(seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, 1, rng.integers(1, 10)) ** rng.choice([1, 3]), rng.choice([1, 6]))
    assert np.allclose(padjust.hommel(p), np.minimum(plain_hommel(p.tolist()), 1))


def test_hommel_of_families_with_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, None if i % 5 == 0 else float(rng.uniform() ** 2)) for f in "ab" for i in range(12)]
    got = padjust.adjusted(spark.createDataFrame(rows, "f string, i int, p double"), "p", ["f"], ["i"], "hommel").collect()
    for f in "ab":
        own = [r for r in got if r.f == f and r.p is not None]
        assert np.allclose([r.padj for r in own], np.minimum(plain_hommel([r.p for r in own]), 1))
    assert all(r.padj is None for r in got if r.p is None) and len(got) == 24
