"""Queries over alignments, validation, order and external counts, with their SQL.

An alignment is a line: its order is the fragment, its supplier's number gives the sample, its part the place, and what it was returned or
shipped as decides whether it spans no intron, one or two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import counting, metrics, ranks
from ..sources import bam, files, increments, sequence, shared
from ..sources.cohort import cohort, table
from .splicing import METRICS_SQL, TEST_SQL, genes_of, query, tested

#: gap and second are the lengths of the introns, 0 where there is none; first is the stretch before.
ALIGNMENT_SQL = """,
al AS (SELECT l_orderkey AS read_id, l_suppkey % 10 AS sample_id, 'chr' || (l_partkey % 5) AS seqname, (l_partkey % 50) * 400 AS pos, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, 1 + l_linenumber % 2 AS mate, (l_quantity % 40)::INT AS mapq,
  10 + l_linenumber AS first, CASE WHEN l_linestatus = 'F' THEN 100 * (1 + l_suppkey % 4) ELSE 0 END AS gap, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 50 ELSE 0 END AS second FROM lineitem),
stranded AS (SELECT *, CASE WHEN mate = 2 THEN CASE strand WHEN '+' THEN '-' ELSE '+' END ELSE strand END AS fs FROM al),
intron AS (SELECT read_id, sample_id, seqname, mapq, fs, strand, pos + first AS start, pos + first + gap - 1 AS "end" FROM stranded WHERE gap > 0
  UNION ALL SELECT read_id, sample_id, seqname, mapq, fs, strand, pos + first + gap + 15, pos + first + gap + 15 + second - 1 FROM stranded WHERE second > 0),
block AS (SELECT read_id, sample_id, seqname, pos AS start, CASE WHEN gap > 0 THEN pos + first - 1 ELSE pos + first + 29 END AS "end" FROM al
  UNION ALL SELECT read_id, sample_id, seqname, pos + first + gap, pos + first + gap + CASE WHEN second > 0 THEN 14 ELSE 19 END FROM al WHERE gap > 0
  UNION ALL SELECT read_id, sample_id, seqname, pos + first + gap + 15 + second, pos + first + gap + 15 + second + 9 FROM al WHERE second > 0)"""


def alignments(spark, sf_dir):
    gap = 100 * (1 + F.col("l_suppkey") % 4)
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    first = (10 + F.col("l_linenumber")).cast("string")
    cigar = F.when(F.col("l_linestatus") != "F", text((40 + F.col("l_linenumber")).cast("string"), "M")).when(F.col("l_returnflag") == "R", text(first, "M", gap.cast("string"), "N15M50N10M")).otherwise(text(first, "M", gap.cast("string"), "N20M"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 10).alias("sample_id"), F.concat(F.lit("chr"), F.col("l_partkey") % 5).alias("seqname"), (F.col("l_partkey") % 50 * 400).alias("pos"), cigar.alias("cigar"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), (1 + F.col("l_linenumber") % 2).alias("mate"), (F.col("l_quantity") % 40).cast("int").alias("mapq"),
    )


def samples(spark, sf_dir):
    return alignments(spark, sf_dir).select("sample_id").distinct()


@query("SELECT sample_id, seqname, count(*) AS n FROM al GROUP BY ALL", ALIGNMENT_SQL)
def mapped_chromosomes(spark, sf_dir):
    return counting.mapped_chromosomes(alignments(spark, sf_dir))


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(DISTINCT read_id) AS k FROM intron GROUP BY ALL", ALIGNMENT_SQL)
def split_reads_paired(spark, sf_dir):
    return counting.split_counts(alignments(spark, sf_dir))


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(*) AS k FROM intron GROUP BY ALL", ALIGNMENT_SQL)
def split_reads_single(spark, sf_dir):
    return counting.split_counts(alignments(spark, sf_dir), paired=False)


@query("SELECT sample_id, seqname, start, \"end\", fs AS strand, count(DISTINCT read_id) AS k FROM intron GROUP BY ALL", ALIGNMENT_SQL)
def split_reads_stranded(spark, sf_dir):
    return counting.split_counts(alignments(spark, sf_dir), counting.FORWARD)


@query("SELECT sample_id, seqname, start, \"end\", CASE fs WHEN '+' THEN '-' ELSE '+' END AS strand, count(DISTINCT read_id) AS k FROM intron GROUP BY ALL", ALIGNMENT_SQL)
def split_reads_reverse(spark, sf_dir):
    return counting.split_counts(alignments(spark, sf_dir), counting.REVERSE)


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(DISTINCT read_id) AS k FROM intron WHERE seqname IN ('chr1', 'chr3') AND mapq >= 10 GROUP BY ALL", ALIGNMENT_SQL)
def split_reads_restricted(spark, sf_dir):
    return counting.split_counts(counting.restricted(alignments(spark, sf_dir), ("chr1", "chr3"), 10))


EXPRESSED = ALIGNMENT_SQL + """,
sp AS (SELECT sample_id, seqname, start, "end", '*' AS strand, count(DISTINCT read_id) AS k FROM intron GROUP BY ALL),
ex AS (SELECT seqname, start, "end", strand FROM sp GROUP BY ALL HAVING max(k) >= 20),
st AS (SELECT DISTINCT seqname, start - 1 AS start, start AS "end", strand, 'Donor' AS type FROM ex UNION SELECT seqname, "end", "end" + 1, strand, 'Acceptor' FROM ex),
hit AS (SELECT DISTINCT s.seqname, s.start AS s, s."end" AS e, s.type, b.sample_id, b.read_id, x FROM st s JOIN block b ON b.seqname = s.seqname AND b.start <= s."end" + 5 AND b."end" >= s.start - 5, unnest(generate_series(greatest(b.start, s.start - 5), least(b."end", s."end" + 5))) AS u(x))"""


@query("SELECT seqname, start, \"end\", strand FROM ex", EXPRESSED)
def expressed_junctions(spark, sf_dir):
    return counting.expressed(counting.split_counts(alignments(spark, sf_dir)), 20)


@query("SELECT concat_ws(':', seqname, concat_ws('-', start, \"end\"), strand) AS junction_id, seqname, start, \"end\", strand, concat_ws(':', seqname, concat_ws('-', start - 1, start), strand) AS start_id, concat_ws(':', seqname, concat_ws('-', \"end\", \"end\" + 1), strand) AS end_id FROM ex", EXPRESSED)
def counted_junctions(spark, sf_dir):
    """Junctions of a counted dataset, with the sites that their coordinates give."""
    return counting.count_dataset(alignments(spark, sf_dir), samples(spark, sf_dir)).junctions


@query("SELECT seqname, start, \"end\", strand, type FROM st", EXPRESSED)
def counted_sites(spark, sf_dir):
    return counting.count_dataset(alignments(spark, sf_dir), samples(spark, sf_dir)).sites.drop("site_id")


@query("SELECT concat_ws(':', seqname, concat_ws('-', s, e), '*') AS site_id, sample_id, count(*) AS k FROM (SELECT seqname, s, e, sample_id, read_id FROM (SELECT DISTINCT seqname, s, e, sample_id, read_id, x FROM hit) GROUP BY ALL HAVING count(*) >= 10) GROUP BY ALL", EXPRESSED)
def counted_nonsplit_reads(spark, sf_dir):
    """Fragments with ten bases at least in the window of twelve around a site, bases of both mates counted once."""
    ds = counting.count_dataset(alignments(spark, sf_dir), samples(spark, sf_dir))
    return ds.ss_counts


#: Junctions with two fragments in some sample, of which tables of every size have many.
TWICE = EXPRESSED.replace("HAVING max(k) >= 20", "HAVING max(k) >= 2")


@query("SELECT concat_ws(':', seqname, concat_ws('-', s, e), '*') AS site_id, sample_id, count(*) AS k FROM (SELECT seqname, s, e, sample_id, read_id FROM (SELECT DISTINCT seqname, s, e, sample_id, read_id, x FROM hit) GROUP BY ALL HAVING count(*) >= 10) GROUP BY ALL", TWICE)
def counted_nonsplit_pairs(spark, sf_dir):
    """Fragments at the sites of all junctions that two fragments of a sample span."""
    return counting.count_dataset(alignments(spark, sf_dir), samples(spark, sf_dir), min_expression=2).ss_counts


@query("SELECT concat_ws(':', seqname, concat_ws('-', start, \"end\"), strand) AS junction_id, seqname, start, \"end\", strand, concat_ws(':', seqname, concat_ws('-', start - 1, start), strand) AS start_id, concat_ws(':', seqname, concat_ws('-', \"end\", \"end\" + 1), strand) AS end_id FROM ex", TWICE)
def counted_junctions_twice(spark, sf_dir):
    return counting.count_dataset(alignments(spark, sf_dir), samples(spark, sf_dir), min_expression=2).junctions


SINGLE = ALIGNMENT_SQL + """,
ex AS (SELECT seqname, start, "end" FROM (SELECT sample_id, seqname, start, "end", count(*) AS k FROM intron GROUP BY ALL) GROUP BY ALL HAVING max(k) >= 2),
st AS (SELECT DISTINCT seqname, start - 1 AS s, start AS e FROM ex UNION SELECT seqname, "end", "end" + 1 FROM ex)"""


@query("SELECT concat_ws(':', st.seqname, concat_ws('-', s, e), '*') AS site_id, sample_id, count(*) AS k FROM st JOIN block b ON b.seqname = st.seqname AND least(b.\"end\", e + 5) - greatest(b.start, s - 5) + 1 >= 10 GROUP BY ALL", SINGLE)
def counted_nonsplit_single(spark, sf_dir):
    """Single-end reads count one by one, those of one name or in repeated rows as well; no two stretches of a line are in one window."""
    return counting.count_dataset(alignments(spark, sf_dir), samples(spark, sf_dir), paired=False, min_expression=2).ss_counts


#: A long read is an order with a stretch and an intron for each of its lines; two orders share a name, as the parts of a read that is aligned in pieces do.
LONG_SQL = """,
lo AS (SELECT l_orderkey AS al, l_orderkey // 50 % 10 AS sample_id, 'chr' || (l_orderkey % 5) AS seqname, l_orderkey % 50 * 40 + 1 AS pos, 20 + 10 * (l_partkey % 3) AS m, 100 * (1 + l_suppkey % 4) AS g, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
  coalesce(sum(20 + 10 * (l_partkey % 3) + 100 * (1 + l_suppkey % 4)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
lb AS (SELECT al, sample_id, seqname, pos + before AS start, pos + before + m - 1 AS "end" FROM lo),
ls AS (SELECT sample_id, seqname, pos + before + m AS start, pos + before + m + g - 1 AS "end", count(*) AS k FROM lo WHERE i < n GROUP BY ALL),
lx AS (SELECT seqname, start, "end" FROM ls GROUP BY ALL HAVING max(k) >= 2),
lt AS (SELECT DISTINCT seqname, start - 1 AS s, start AS e FROM lx UNION SELECT seqname, "end", "end" + 1 FROM lx)"""


def long_reads(spark, sf_dir):
    parts = F.transform(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))),
        lambda x: F.concat((20 + 10 * (x["l_partkey"] % 3)).cast("string"), F.lit("M"), (100 * (1 + x["l_suppkey"] % 4)).cast("string"), F.lit("N")),
    )
    order = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.regexp_replace(F.array_join(parts, ""), r"\d+N$", "").alias("cigar"))
    return rows.select(
        F.floor(order / 2).alias("read_id"), (F.floor(order / 50) % 10).alias("sample_id"), F.concat(F.lit("chr"), order % 5).alias("seqname"),
        (order % 50 * 40 + 1).alias("pos"), "cigar", F.lit("+").alias("strand"),
    )


def long_dataset(spark, sf_dir):
    reads = long_reads(spark, sf_dir)
    return counting.count_dataset(reads, reads.select("sample_id").distinct(), paired=False, min_expression=2)


@query("SELECT concat_ws(':', seqname, concat_ws('-', start, \"end\"), '*') AS junction_id, sample_id, k FROM ls JOIN lx USING (seqname, start, \"end\")", LONG_SQL)
def long_read_junctions(spark, sf_dir):
    """Long reads over any number of introns."""
    return long_dataset(spark, sf_dir).j_counts


@query("SELECT concat_ws(':', seqname, concat_ws('-', s, e), '*') AS site_id, sample_id, count(*) AS k FROM (SELECT lt.seqname, s, e, sample_id, al FROM lt JOIN lb ON lb.seqname = lt.seqname AND lb.start <= e + 5 AND lb.\"end\" >= s - 5 GROUP BY ALL HAVING sum(least(lb.\"end\", e + 5) - greatest(lb.start, s - 5) + 1) >= 10) GROUP BY ALL", LONG_SQL)
def long_read_nonsplit(spark, sf_dir):
    """Long reads that run through a site, each alignment by itself."""
    return long_dataset(spark, sf_dir).ss_counts


MOTIF = "SELECT seqname, start, \"end\", CASE WHEN start % 3 = 0 THEN '-' ELSE '+' END AS strand FROM sp WHERE start % 7 > 0"


@query(f"SELECT sample_id, a.seqname, a.start, a.\"end\", coalesce(m.strand, '+') AS strand, k FROM sp a LEFT JOIN (SELECT DISTINCT * FROM ({MOTIF})) m ON m.seqname = a.seqname AND m.start = a.start AND m.\"end\" = a.\"end\"", EXPRESSED)
def motif_strands(spark, sf_dir):
    counts = counting.split_counts(alignments(spark, sf_dir))
    motifs = counts.filter("start % 7 > 0").select("seqname", "start", "end", F.when(F.col("start") % 3 == 0, "-").otherwise("+").alias("strand"))
    return counting.with_motif_strand(counts, motifs)


@query("SELECT CASE WHEN count(*) FILTER (seqname LIKE 'chr%') >= count(*) FILTER (seqname NOT LIKE 'chr%') THEN 'UCSC' ELSE 'NCBI' END AS style FROM al", ALIGNMENT_SQL)
def chromosome_style(spark, sf_dir):
    return counting.common_chromosome_style(alignments(spark, sf_dir)).select("style")


@query("SELECT 'chr' || (p_partkey % 40) AS seqname, min(p_size) AS length FROM part GROUP BY 1 HAVING count(DISTINCT p_size) = 1")
def uniform_chromosomes(spark, sf_dir):
    return counting.uniform_chromosomes(table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), F.col("p_partkey") % 40).alias("seqname"), F.col("p_size").alias("length")))


@query("SELECT seqname, start, \"end\", strand, row_number() OVER (ORDER BY start, \"end\", seqname, strand) AS number FROM junctions")
def junction_numbers(spark, sf_dir):
    return ranks.numbered(cohort(spark, sf_dir).junctions.select("seqname", "start", "end", "strand"), ["start", "end", "seqname", "strand"])


@query("SELECT seqname, start, strand, row_number() OVER (ORDER BY f, seqname, start, strand) AS group_number FROM (SELECT seqname, start, strand, min(junction_id) AS f FROM junctions GROUP BY ALL)")
def site_group_numbers(spark, sf_dir):
    return ranks.group_numbers(cohort(spark, sf_dir).junctions, ["seqname", "start", "strand"], ["junction_id"])


@query("SELECT junction_id, row_number() OVER (ORDER BY substr(seqname, 4)::INT, CASE strand WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 3 END, start, \"end\") AS place FROM junctions")
def genomic_sort(spark, sf_dir):
    ordered = ranks.genomic_order(cohort(spark, sf_dir).junctions)
    # the place in the sorted rows, so that the order itself is compared
    keyed = ordered.withColumns({"c": F.substring("seqname", 4, 9).cast("int"), "s": F.array_position(F.array(F.lit("+"), F.lit("-"), F.lit("*")), F.col("strand"))})
    return ranks.numbered(keyed, ["c", "s", "start", "end"], "place").select("junction_id", "place")


def _auc_sql() -> str:
    whole = lambda x: f"({x} / (1 + h) - CASE WHEN c = 0 THEN 0 ELSE c / ((1 + h) * (1 + h)) * ln((1 + h) * {x} + c) END)"
    return f"""SELECT round(sum(CASE WHEN t > 0 THEN {whole('tp')} - {whole('(tp - t)')} END) / sum(t), 7) AS auc FROM (SELECT *, f / nullif(t, 0)::DOUBLE AS h, (fp - f) - f / nullif(t, 0)::DOUBLE * (tp - t) AS c FROM
(SELECT score, t, f, sum(t) OVER (ORDER BY score DESC) AS tp, sum(f) OVER (ORDER BY score DESC) AS fp FROM (SELECT coalesce(score, (SELECT min(score) FROM pr) - 1) AS score, (count(*) FILTER (label))::DOUBLE AS t, (count(*) FILTER (NOT label))::DOUBLE AS f FROM pr GROUP BY 1)))"""


@query(_auc_sql(), TEST_SQL + ", pr AS (SELECT -p AS score, coalesce(abs(round(jaccard - mu, 9)) >= 0.05, false) AS label FROM pv)")
def precision_recall_auc(spark, sf_dir):
    label = F.coalesce(F.abs(F.round(F.col("jaccard") - F.col("mu"), 9)) >= 0.05, F.lit(False))
    return ranks.precision_recall_auc(tested(spark, sf_dir).select((-F.col("p")).alias("score"), label.alias("label"))).select(F.round("auc", 7).alias("auc"))


@query("SELECT junction_id, sample_id, k::BIGINT AS k FROM (SELECT junction_id, sample_id, k FROM grid WHERE k > 0)")
def wide_counts_round_trip(spark, sf_dir):
    """Counts written wide, a column for each sample, and read back to rows."""
    ds = cohort(spark, sf_dir)
    names = [str(r.sample_id) for r in ds.samples.select("sample_id").sort("sample_id").collect()]
    wide = ds.grid().groupBy("junction_id").pivot("sample_id", [int(n) for n in names]).agg(F.first("k"))
    return files.from_wide(wide, ["junction_id"], names).filter("k > 0").select("junction_id", F.col("sample_id").cast("int").alias("sample_id"), "k")


@query("SELECT region, n_nationkey, flag FROM (SELECT r_name AS region, n_nationkey, NULL::VARCHAR AS flag FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT NULL, s_nationkey, 'supplier' FROM (SELECT DISTINCT s_nationkey FROM supplier))")
def fill_union(spark, sf_dir):
    a = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), "n_nationkey")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("flag", F.lit("supplier"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT junction_id FROM jc WHERE sample_id < 12 INTERSECT SELECT junction_id FROM jc WHERE sample_id >= 12")
def junctions_of_both_groups(spark, sf_dir):
    counts = cohort(spark, sf_dir).j_counts
    return counts.filter("sample_id < 12").select("junction_id").intersect(counts.filter("sample_id >= 12").select("junction_id"))


@query("SELECT gene, count(*) AS n FROM (SELECT 'g' || (start_id % 8) AS gene FROM junctions) GROUP BY 1")
def value_counts(spark, sf_dir):
    return genes_of(cohort(spark, sf_dir)).filter("gene like 'g%'").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


#: External counts: those of the cohort itself moved to samples of 100 and above, for the junctions of even donors and one unknown range.
EXTERNAL_SQL = METRICS_SQL + """,
shared AS (SELECT junction_id, seqname, start, "end", strand, start_id, end_id FROM junctions WHERE start_id % 2 = 0),
xs AS (SELECT DISTINCT site_id, seqname, start, "end", strand FROM sites WHERE site_id IN (SELECT start_id FROM shared UNION SELECT end_id FROM shared))"""


def external(spark, sf_dir, ds):
    moved = lambda df: df.withColumn("sample_id", F.col("sample_id") + 100)
    own = metrics.prime_sites(ds).filter("start_id % 2 = 0")
    at = ["seqname", "start", "end", "strand", "sample_id"]
    theta = metrics.site_theta(ds)
    unknown = spark.range(1).select(F.lit("chr1").alias("seqname"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("+").alias("strand"), F.lit(0).alias("sample_id"), F.lit(9).cast("long").alias("k"))
    return {
        "k_j": moved(own.select(*at, "k").unionByName(unknown)), "n_psi5": moved(own.select(*at, (F.col("k") + F.col("o_psi5")).alias("k"))), "n_psi3": moved(own.select(*at, (F.col("k") + F.col("o_psi3")).alias("k"))),
        "k_theta": moved(theta.select(*at, "k")), "n_theta": moved(theta.select(*at, (F.col("k") + F.col("o_theta")).alias("k"))),
    }


def merged(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    return counting.merge_external(ds, external(spark, sf_dir, ds), ds.samples.select((F.col("sample_id") + 100).alias("sample_id"), F.lit("external").alias("group")))


@query("SELECT junction_id, sample_id::VARCHAR AS sample_id, k::BIGINT AS k FROM jc WHERE junction_id IN (SELECT junction_id FROM shared) UNION ALL SELECT junction_id, (sample_id + 100)::VARCHAR, k FROM grid WHERE junction_id IN (SELECT junction_id FROM shared)", EXTERNAL_SQL)
def external_junction_counts(spark, sf_dir):
    return merged(spark, sf_dir)[0].j_counts


@query("SELECT junction_id, (sample_id + 100)::VARCHAR AS sample_id, o_psi5::BIGINT AS o_psi5, o_psi3::BIGINT AS o_psi3 FROM prime WHERE junction_id IN (SELECT junction_id FROM shared)", EXTERNAL_SQL)
def external_other_counts(spark, sf_dir):
    return merged(spark, sf_dir)[1]


@query("SELECT site_id, (t.sample_id + 100)::VARCHAR AS sample_id, o_theta::BIGINT AS o_theta FROM th t JOIN xs x USING (site_id, seqname, start, \"end\", strand)", EXTERNAL_SQL)
def external_site_counts(spark, sf_dir):
    return merged(spark, sf_dir)[2]


@query("SELECT junction_id, sample_id, round(jaccard - median(jaccard) OVER w, 9) AS dj, round(psi5 - median(psi5) OVER w, 9) AS d5, round(psi3 - median(psi3) OVER w, 9) AS d3 FROM m WINDOW w AS (PARTITION BY junction_id)", METRICS_SQL)
def all_ratios(spark, sf_dir):
    out = metrics.all_ratios(cohort(spark, sf_dir))
    return out.select("junction_id", "sample_id", *[F.round(f"delta_median_{m}", 9).alias(n) for m, n in (("jaccard", "dj"), ("psi5", "d5"), ("psi3", "d3"))])



# --- alignments in files ------------------------------------------------------------------------

_folders: dict = {}


def bam_folder(spark, sf_dir):
    """The alignments as indexed BAM files, written once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        path = f"{shared.shared_dir(spark)}/alignments-{uuid.uuid4().hex}"
        rows = alignments(spark, sf_dir)
        ends = rows.groupBy("seqname").agg(F.max("pos").alias("last")).sort("seqname").collect()  # one row for each sequence
        bam.write_alignments(rows, path, [(r.seqname, r["last"] + 10_000) for r in ends])
        _folders[key] = path
    return _folders[key]


def from_files(spark, sf_dir, **asked):
    rows = bam.read_alignments(spark, bam_folder(spark, sf_dir), split=1 << 18, **asked)
    return rows.withColumns({"read_id": F.col("read_id").cast("long"), "sample_id": F.col("sample_id").cast("long")})


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(DISTINCT read_id) AS k FROM intron GROUP BY ALL", ALIGNMENT_SQL)
def file_split_reads_paired(spark, sf_dir):
    return counting.split_counts(from_files(spark, sf_dir))


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(*) AS k FROM intron GROUP BY ALL", ALIGNMENT_SQL)
def file_split_reads_single(spark, sf_dir):
    return counting.split_counts(from_files(spark, sf_dir), paired=False)


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(DISTINCT read_id) AS k FROM intron WHERE seqname IN ('chr1', 'chr3') AND mapq >= 10 GROUP BY ALL", ALIGNMENT_SQL)
def file_split_reads_restricted(spark, sf_dir):
    """Sequences and mapping quality as the reader takes them: other stretches of the files are not read."""
    return counting.split_counts(from_files(spark, sf_dir, chromosomes=["chr1", "chr3"], min_mapq=10))


SPANS = "SELECT read_id, sample_id, seqname, pos, mapq, strand, mate FROM al JOIN (SELECT 'chr2' AS s, 3000 AS a, 9000 AS b UNION ALL SELECT 'chr0', 19000, 30000) ON seqname = s AND pos <= b AND pos + CASE WHEN gap = 0 THEN first + 30 WHEN second > 0 THEN first + gap + second + 25 ELSE first + gap + 20 END - 1 >= a"


@query(SPANS, ALIGNMENT_SQL)
def file_regions(spark, sf_dir):
    """Alignments that overlap two regions, by the index."""
    return from_files(spark, sf_dir, regions=[("chr2", 3000, 9000), ("chr0", 19_000, 30_000)]).select("read_id", "sample_id", "seqname", F.col("pos").cast("long").alias("pos"), "mapq", "strand", F.col("mate").cast("long").alias("mate"))


@query("SELECT sample_id, seqname, start, \"end\", '*' AS strand, count(DISTINCT read_id) AS k FROM intron JOIN (SELECT sample_id, read_id FROM al GROUP BY ALL HAVING bool_or(mate = 1) AND bool_or(mate = 2) AND min(seqname) = max(seqname)) USING (sample_id, read_id) GROUP BY ALL", ALIGNMENT_SQL)
def proper_pair_split_reads(spark, sf_dir):
    """Split reads of fragments of two mates on one sequence, mates joined by name."""
    return counting.split_counts(counting.proper_pairs(from_files(spark, sf_dir)))


# --- counts that are kept by sample -------------------------------------------------------------


def incremental(spark, sf_dir):
    """The samples below 7 first, then all of them: the others are added to what is kept."""
    path = f"{shared.shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    reader, known = increments.table_reader(alignments(spark, sf_dir)), samples(spark, sf_dir)
    increments.count_samples(spark, reader, known.filter("sample_id < 7"), path)
    return increments.count_samples(spark, reader, known, path)


@query("SELECT concat_ws(':', seqname, concat_ws('-', start, \"end\"), strand) AS junction_id, sample_id, k FROM sp JOIN ex USING (seqname, start, \"end\", strand)", EXPRESSED)
def incremental_split_reads(spark, sf_dir):
    return incremental(spark, sf_dir).j_counts


@query("SELECT concat_ws(':', seqname, concat_ws('-', s, e), '*') AS site_id, sample_id, count(*) AS k FROM (SELECT seqname, s, e, sample_id, read_id FROM (SELECT DISTINCT seqname, s, e, sample_id, read_id, x FROM hit) GROUP BY ALL HAVING count(*) >= 10) GROUP BY ALL", EXPRESSED)
def incremental_nonsplit_reads(spark, sf_dir):
    return incremental(spark, sf_dir).ss_counts


# --- sequences ----------------------------------------------------------------------------------

#: The base at place x of chromosome c comes from the size of a part.
BASES_SQL = """,
np AS (SELECT count(*) AS n FROM part),
pl AS (SELECT DISTINCT seqname, start, "end" FROM sp),
ends AS (SELECT seqname, start, "end", unnest([start, start + 1, "end" - 1, "end"]) AS x, unnest([1, 2, 3, 4]) AS o FROM pl),
mo AS (SELECT seqname, start, "end", string_agg(substr('ACGTAG', (1 + (p_size + x) % 6)::INT, 1), '' ORDER BY o) AS m FROM ends, np, part WHERE p_partkey = (x + 37 * substr(seqname, 4)::INT) % n GROUP BY ALL),
st2 AS (SELECT seqname, start, "end", m[1:2] || '-' || m[3:4] AS motif, CASE WHEN m IN ('GTAG', 'GCAG', 'ATAC', 'ATAA', 'ATAG') THEN '+' WHEN m IN ('CTAC', 'CTGC', 'GTAT', 'TTAT', 'CTAT') THEN '-' ELSE '*' END AS strand FROM mo)"""


def genome(spark, sf_dir, width: int = 60, size: int = 21_600):
    """FASTA files of five chromosomes, their bases taken from the parts, as chunks."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = parts.count()
    places = spark.range(1, size + 1).withColumnRenamed("id", "x").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4))))
    base = F.substring(F.lit("ACGTAG"), (1 + (F.col("p_size") + F.col("x")) % 6).cast("int"), F.lit(1))
    bases = places.join(parts, F.col("p_partkey") == (F.col("x") + 37 * F.col("c")) % n).select("c", "x", base.alias("b"))
    lines = bases.groupBy("c", F.floor((F.col("x") - 1) / width).alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "b"))), lambda s: s["b"]), "").alias("value"))
    heads = spark.range(5).select(F.col("id").cast("int").alias("c"), F.lit(-1).cast("long").alias("line"), F.concat(F.lit(">chr"), F.col("id"), F.lit(" of parts")).alias("value"))
    path = f"{shared.shared_dir(spark)}/genome-{uuid.uuid4().hex}"
    heads.unionByName(lines).repartition(3, "c").sortWithinPartitions("c", "line").select("value").write.text(path)
    return sequence.read_fasta(spark, path, 1000, 8)


@query("SELECT seqname, start, \"end\", motif, strand FROM st2", EXPRESSED + BASES_SQL)
def intron_motifs(spark, sf_dir):
    """The ends of every intron looked up in the sequence."""
    counts = counting.split_counts(alignments(spark, sf_dir))
    return sequence.intron_motifs(counts, genome(spark, sf_dir), 1000, 8)


@query("SELECT sample_id, a.seqname, a.start, a.\"end\", CASE WHEN s.strand = '*' THEN '+' ELSE s.strand END AS strand, k FROM sp a JOIN st2 s ON s.seqname = a.seqname AND s.start = a.start AND s.\"end\" = a.\"end\"", EXPRESSED + BASES_SQL)
def sequence_strands(spark, sf_dir):
    """Unstranded counts with the strand of the motif that the sequence has at the intron's ends."""
    counts = counting.split_counts(alignments(spark, sf_dir))
    return counting.with_motif_strand(counts, sequence.intron_motifs(counts, genome(spark, sf_dir), 1000, 8))
