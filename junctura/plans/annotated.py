"""Queries over ranges, annotation, results and plot data, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, exonchain, intervals, metrics, padjust, results
from ..sources.cohort import cohort, table, jaccard_cells
from .splicing import GENE_SQL, METRICS_SQL, ORACLE_SQL, QUERIES, SITE_PADJ, SUBSET_PADJ, TEST_SQL, five_prime, genes_of, query, site_tests, tested

#: Reads are ranges of part numbers, as long as their quantity; regions are windows of 64 suppliers' parts.
RANGE_SQL = """,
rd AS (SELECT l_orderkey, l_linenumber, 'chr' || (l_suppkey % 5) AS seqname, l_partkey * 20 AS start, l_partkey * 20 + l_quantity::BIGINT AS "end", CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand FROM lineitem),
rg AS (SELECT p_partkey AS region, 'chr' || (p_partkey % 5) AS seqname, p_partkey * 20 - 30 * (p_partkey % 2) AS start, p_partkey * 20 + 3 * p_size AS "end", CASE p_partkey % 2 WHEN 0 THEN '+' ELSE '*' END AS strand FROM part)"""


def reads(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("seqname"), (F.col("l_partkey") * 20).alias("start"), (F.col("l_partkey") * 20 + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_linenumber") % 3 == 0, "+").when(F.col("l_linenumber") % 3 == 1, "-").otherwise("*").alias("strand"))


def regions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("seqname"), (F.col("p_partkey") * 20 - 30 * (F.col("p_partkey") % 2)).alias("start"), (F.col("p_partkey") * 20 + 3 * F.col("p_size")).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("*").alias("strand"))


SAME = "a.seqname = b.seqname AND (a.strand = b.strand OR a.strand = '*' OR b.strand = '*')"
KINDS = {"any": "a.start <= b.\"end\" AND a.\"end\" >= b.start", "within": "b.start <= a.start AND a.\"end\" <= b.\"end\"", "start": "a.start = b.start", "end": "a.\"end\" = b.\"end\"", "equal": "a.start = b.start AND a.\"end\" = b.\"end\""}


def _interval(kind: str):
    def run(spark, sf_dir):
        return intervals.overlap(reads(spark, sf_dir), regions(spark, sf_dir), 128, kind=kind).groupBy("b.region").agg(F.count(F.lit(1)).alias("n"), F.sum("a.l_orderkey").alias("orders"))

    run.__name__ = f"interval_join_{kind}"
    query(f"SELECT region, count(*) AS n, sum(a.l_orderkey)::BIGINT AS orders FROM rd a JOIN rg b ON {SAME} AND {KINDS[kind]} GROUP BY 1", RANGE_SQL)(run)


for _k in KINDS:
    _interval(_k)


@query(f"SELECT count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS orders, l_linenumber FROM rd a WHERE NOT EXISTS (SELECT 1 FROM rg b WHERE {SAME} AND {KINDS['any']}) GROUP BY ALL", RANGE_SQL)
def interval_anti_join(spark, sf_dir):
    kept = intervals.overlaps_any(reads(spark, sf_dir), regions(spark, sf_dir), ["l_orderkey", "l_linenumber", "seqname", "start", "end", "strand"], 128, anti=True)
    return kept.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"))


@query(f"SELECT l_orderkey, l_linenumber, arg_min(b.region, (-(b.\"end\" - b.start), b.region)) AS region FROM rd a JOIN rg b ON {SAME} AND {KINDS['any']} GROUP BY ALL", RANGE_SQL)
def interval_first_overlap(spark, sf_dir):
    first = intervals.first_overlap(reads(spark, sf_dir), regions(spark, sf_dir), ["l_orderkey", "l_linenumber"], [-(F.col("b.end") - F.col("b.start")), F.col("b.region")], 128)
    return first.select("l_orderkey", "l_linenumber", "b.region")


@query(
    "SELECT s_suppkey, min(greatest(0, b.start - a.\"end\" - 1, a.start - b.\"end\" - 1))::BIGINT AS distance FROM (SELECT s_suppkey, 'chr' || (s_suppkey % 5) AS seqname, s_suppkey * 37 % 4001 * 10 AS start, s_suppkey * 37 % 4001 * 10 + 5 AS \"end\" FROM supplier) a JOIN rg b ON a.seqname = b.seqname GROUP BY 1",
    RANGE_SQL,
)
def nearest_range(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("chr"), F.col("s_suppkey") % 5).alias("seqname"), (F.col("s_suppkey") * 37 % 4001 * 10).alias("start"), (F.col("s_suppkey") * 37 % 4001 * 10 + 5).alias("end"))
    return intervals.nearest(a, regions(spark, sf_dir), "s_suppkey", "region").filter("distance is not null").select("s_suppkey", F.col("distance").cast("long").alias("distance"))


@query(
    f"SELECT b.region AS site_id, a.l_linenumber AS sample_id, count(DISTINCT a.l_orderkey) AS k FROM rd a JOIN (SELECT region, seqname, start - 5 AS start, \"end\" + 5 AS \"end\", strand FROM rg) b ON {SAME} AND least(a.\"end\", b.\"end\") - greatest(a.start, b.start) + 1 >= 10 GROUP BY ALL",
    RANGE_SQL,
)
def nonsplit_read_counting(spark, sf_dir):
    r = reads(spark, sf_dir).withColumnsRenamed({"l_linenumber": "sample_id", "l_orderkey": "fragment"})
    return intervals.nonsplit_counts(r, regions(spark, sf_dir).withColumnRenamed("region", "site_id"), 5, 128)


@query(
    "SELECT seqname, pos AS start, nxt - 1 AS \"end\", depth FROM (SELECT seqname, pos, sum(d) OVER (PARTITION BY seqname ORDER BY pos)::BIGINT AS depth, lead(pos) OVER (PARTITION BY seqname ORDER BY pos) AS nxt FROM (SELECT seqname, pos, sum(d) AS d FROM (SELECT seqname, start AS pos, 1 AS d FROM rd UNION ALL SELECT seqname, \"end\" + 1, -1 FROM rd) GROUP BY ALL)) WHERE depth > 0",
    RANGE_SQL,
)
def read_coverage(spark, sf_dir):
    return intervals.coverage(reads(spark, sf_dir), [])


ANN_SQL = """,
gn AS (SELECT 'G' || s_suppkey AS gene_id, 'SYM' || (s_suppkey % 13) AS symbol, 'chr' || (s_suppkey % 3 + 1) AS seqname, s_suppkey * 290 AS start, s_suppkey * 290 + 1500 AS "end", CASE s_suppkey % 2 WHEN 0 THEN '+' ELSE '-' END AS strand FROM supplier),
intr AS (SELECT j.seqname, j.start, j."end", j.strand, 'T' || (junction_id % 7) AS transcript_id, median(k) AS median_count FROM grid j JOIN nation ON n_nationkey = junction_id % 25 JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY ALL),
bl AS (SELECT 'chr' || (p_partkey % 3 + 1) AS seqname, 20000 + p_partkey * 7 AS start, 20000 + p_partkey * 7 + p_size AS "end" FROM part)"""


def gene_table(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("gene_id"), F.concat(F.lit("SYM"), F.col("s_suppkey") % 13).alias("symbol"), F.concat(F.lit("chr"), F.col("s_suppkey") % 3 + 1).alias("seqname"), (F.col("s_suppkey") * 290).alias("start"), (F.col("s_suppkey") * 290 + 1500).alias("end"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"))


@query(f"SELECT j.junction_id, genes FROM junctions j LEFT JOIN (SELECT a.junction_id, string_agg(DISTINCT b.symbol, ';' ORDER BY b.symbol) AS genes FROM junctions a JOIN gn b ON {SAME} AND {KINDS['any']} GROUP BY 1) g USING (junction_id)", ANN_SQL)
def gene_annotation(spark, sf_dir):
    return annotation.gene_labels(cohort(spark, sf_dir).junctions, gene_table(spark, sf_dir), "junction_id")


def reference_introns(spark, sf_dir, ds):
    """Known introns, those whose acceptor's nation lies in Europe, with a transcript and the median of their counts."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_name = 'EUROPE'")
    europe = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("acceptor"))
    known = ds.grid().join(F.broadcast(europe), F.col("junction_id") % 25 == F.col("acceptor"), "left_semi")
    return known.groupBy("junction_id", "seqname", "start", "end", "strand").agg(F.median("k").alias("median_count")).withColumn("transcript_id", F.concat(F.lit("T"), F.col("junction_id") % 7))


@query(
    f"""SELECT a.junction_id, count(b.start) FILTER ({KINDS['equal']}) > 0 AS known_intron, count(b.start) FILTER ({KINDS['start']}) > 0 AS known_start, count(b.start) FILTER ({KINDS['end']}) > 0 AS known_end,
string_agg(DISTINCT b.transcript_id, ',' ORDER BY b.transcript_id) FILTER ({KINDS['equal']}) AS transcripts FROM junctions a LEFT JOIN intr b ON {SAME} AND ({KINDS['start']} OR {KINDS['end']}) GROUP BY 1""",
    ANN_SQL,
)
def known_junctions(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    return annotation.known_ends(ds.junctions, reference_introns(spark, sf_dir, ds))


@query(
    f"""SELECT j.junction_id, CASE WHEN x IS NULL THEN 'none' WHEN x.start = j.start AND x."end" = j."end" THEN 'both' WHEN x.start = j.start THEN 'start' WHEN x."end" = j."end" THEN 'end' ELSE 'none' END AS annotated
FROM junctions j LEFT JOIN (SELECT a.junction_id, arg_min(struct_pack(start := b.start, "end" := b."end"), (-b.median_count, b.start, b."end")) AS x FROM junctions a JOIN intr b ON {SAME} AND {KINDS['any']} GROUP BY 1) t USING (junction_id)""",
    ANN_SQL,
)
def intron_reference_overlap(spark, sf_dir):
    ds = cohort(spark, sf_dir)
    return annotation.reference_overlap(ds.junctions, reference_introns(spark, sf_dir, ds))


@query("SELECT junction_id, EXISTS (SELECT 1 FROM bl b WHERE b.seqname = a.seqname AND (a.start - 5 <= b.\"end\" AND a.start + 4 >= b.start OR a.\"end\" - 4 <= b.\"end\" AND a.\"end\" + 5 >= b.start)) AS blacklisted FROM junctions a", ANN_SQL)
def blacklist_flags(spark, sf_dir):
    return annotation.blacklisted(cohort(spark, sf_dir).junctions, bad_regions(spark, sf_dir))


ENDS = "SELECT junction_id, seqname, strand, start - 5 AS start, start + 4 AS \"end\" FROM junctions UNION ALL SELECT junction_id, seqname, strand, \"end\" - 4, \"end\" + 5 FROM junctions"
#: Genes of a lower number have their UTR before, the others behind.
UTR_HIT = f"SELECT DISTINCT junction_id FROM ({ENDS}) a JOIN gn b ON {SAME} AND {KINDS['any']} WHERE b.symbol %s 'SYM2'"


@query(f"SELECT junction_id, CASE WHEN junction_id IN ({UTR_HIT % '<'}) THEN '5''-UTR' WHEN junction_id IN ({UTR_HIT % '>='}) THEN '3''-UTR' ELSE 'no' END AS utr FROM junctions", ANN_SQL)
def utr_labels(spark, sf_dir):
    g = gene_table(spark, sf_dir)
    return annotation.utr_label(cohort(spark, sf_dir).junctions, g.filter("symbol < 'SYM2'"), g.filter("symbol >= 'SYM2'"), "junction_id")


def bad_regions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), F.col("p_partkey") % 3 + 1).alias("seqname"), (20000 + F.col("p_partkey") * 7).alias("start"), (20000 + F.col("p_partkey") * 7 + F.col("p_size")).alias("end"))


@query(
    f"""SELECT j.junction_id, j.sample_id, CASE WHEN x IS NULL THEN 'none' WHEN x.start = a.start AND x."end" = a."end" THEN 'both' WHEN x.start = a.start THEN 'start' WHEN x."end" = a."end" THEN 'end' ELSE 'none' END AS annotated,
CASE WHEN j.junction_id IN ({UTR_HIT % '<'}) THEN '5''-UTR' WHEN j.junction_id IN ({UTR_HIT % '>='}) THEN '3''-UTR' ELSE 'no' END AS utr,
j.junction_id IN (SELECT junction_id FROM ({ENDS}) a JOIN bl b ON a.seqname = b.seqname AND {KINDS['any']}) AS blacklisted
FROM jc j JOIN junctions a USING (junction_id) LEFT JOIN (SELECT a.junction_id, arg_min(struct_pack(start := b.start, "end" := b."end"), (-b.median_count, b.start, b."end")) AS x FROM junctions a JOIN intr b ON {SAME} AND {KINDS['any']} GROUP BY 1) t USING (junction_id)""",
    ANN_SQL,
)
def annotated_results(spark, sf_dir):
    ds, g = cohort(spark, sf_dir), gene_table(spark, sf_dir)
    rows = ds.j_counts.select("junction_id", "sample_id").join(ds.junctions.select("junction_id", "seqname", "start", "end", "strand"), "junction_id")
    utrs = (g.filter("symbol < 'SYM2'"), g.filter("symbol >= 'SYM2'"))
    return annotation.annotated_results(rows, reference_introns(spark, sf_dir, ds), utrs, bad_regions(spark, sf_dir)).select("junction_id", "sample_id", "annotated", "utr", "blacklisted")


@query("SELECT gene_id, coalesce(symbol, gene_id) AS symbol FROM (SELECT gene_id FROM gn) LEFT JOIN (SELECT 'G' || (p_partkey * 2) AS gene_id, min(p_brand) AS symbol FROM part GROUP BY 1) USING (gene_id)", ANN_SQL)
def gene_symbols(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("G"), F.col("p_partkey") * 2).alias("gene_id"), F.col("p_brand").alias("symbol"))
    return annotation.with_symbols(gene_table(spark, sf_dir), names).select("gene_id", "symbol")


#: A cutoff that some cells of the cohort pass and others miss: the rows have no planted outliers.
PADJ_CUTOFF = 0.9
CALL = f"coalesce(round(padj, 9) <= {PADJ_CUTOFF}, false) AND n >= 5 AND coalesce(abs(delta) >= 0.01, false)"
CALL_SQL = SITE_PADJ + f", cl AS (SELECT *, {CALL} AS aberrant FROM (SELECT *, round(jaccard - mu, 9) AS delta FROM res))"


def calls(spark, sf_dir):
    cells = site_tests(spark, sf_dir).withColumns({"delta": F.round(F.col("jaccard") - F.col("mu"), 9), "padj": F.round("padj", 9)})
    return cells.withColumn("aberrant", results.aberrant(F.col("padj"), F.col("delta"), F.col("n"), None, PADJ_CUTOFF, 0.01, 5))


@query("SELECT sample_id, count(*) FILTER (aberrant) AS n_aberrant FROM cl GROUP BY 1", CALL_SQL)
def aberrant_per_sample(spark, sf_dir):
    return results.counts(calls(spark, sf_dir), "sample_id")


@query("SELECT junction_id, count(*) FILTER (aberrant) AS n_aberrant FROM cl GROUP BY 1", CALL_SQL)
def aberrant_per_feature(spark, sf_dir):
    return results.counts(calls(spark, sf_dir), "junction_id")


@query("SELECT g.gene, g.sample_id, bool_or(loose) AND coalesce(any_value(padj_gene) <= 0.8, false) AS aberrant FROM (SELECT gene, sample_id, n >= 5 AND coalesce(abs(round(jaccard - mu, 9)) >= 0.01, false) AS loose FROM t JOIN gene USING (junction_id)) g JOIN gp ON gp.gene = g.gene AND gp.sample_id = g.sample_id GROUP BY ALL", GENE_SQL)
def aberrant_genes(spark, sf_dir):
    loose = results.aberrant(F.col("padj"), F.col("delta"), F.col("n"), None, None, 0.01, 5)
    cells = tested(spark, sf_dir).withColumns({"delta": F.round(F.col("jaccard") - F.col("mu"), 9), "padj": F.lit(None).cast("double")}).withColumn("loose", loose)
    g = genes_of(cohort(spark, sf_dir))
    return results.gene_calls(cells, g, padjust.gene_p_values(five_prime(spark, sf_dir), g), 0.8)


@query("SELECT junction_id, sample_id, p AS p_value, delta, round(padj, 9) AS padj FROM cl WHERE aberrant", CALL_SQL)
def result_table(spark, sf_dir):
    out = calls(spark, sf_dir).filter("aberrant").select("junction_id", "sample_id", F.col("p").alias("p_value"), "delta", F.round("padj", 9).alias("padj"))
    return results.ordered(out)


@query("SELECT gene, sample_id, arg_min(junction_id, (p, -abs(round(jaccard - mu, 9)), junction_id)) AS junction_id FROM t JOIN pv USING (junction_id, sample_id, jaccard, mu) JOIN gene USING (junction_id) WHERE p IS NOT NULL GROUP BY ALL", TEST_SQL)
def best_junction_per_gene(spark, sf_dir):
    cells = tested(spark, sf_dir).filter("p is not null").select("junction_id", "sample_id", F.col("p").alias("p_value"), F.round(F.col("jaccard") - F.col("mu"), 9).alias("delta"))
    return results.best_per_gene(cells.join(genes_of(cohort(spark, sf_dir)), "junction_id"), ["gene", "sample_id"]).select("gene", "sample_id", "junction_id")


@query(
    f"SELECT junction_id, sample_id, round(a.padj, 9) AS padj_all, round(b.padj_subset, 9) AS padj_thirds FROM res a LEFT JOIN (SELECT sample_id, index, padj_subset FROM ({SUBSET_PADJ})) b USING (sample_id, index)",
    SITE_PADJ,
)
def fdr_set_pivot(spark, sf_dir):
    """The FDR over all sites of a sample beside that over a subset of them."""
    cells = site_tests(spark, sf_dir)
    subset = cells.filter("index % 3 = sample_id % 3").select(F.lit("thirds").alias("subset"), "sample_id", "index")
    part = cells.select("junction_id", "sample_id", "index").join(padjust.fdr_on_subset(cells, subset), ["sample_id", "index"])
    rows = cells.select("junction_id", "sample_id", F.lit("all").alias("fdr_set"), "padj").unionByName(part.select("junction_id", "sample_id", F.col("subset").alias("fdr_set"), F.col("padj_subset").alias("padj")))
    out = results.fdr_sets(rows, ["junction_id", "sample_id"], ["all", "thirds"])
    return out.withColumns({c: F.round(c, 9) for c in ("padj_all", "padj_thirds")})


@query("SELECT sample_id, junction_id, rank, round(-log10((rank - a) / (n + 1 - 2 * a)), 9) AS expected FROM (SELECT sample_id, junction_id, row_number() OVER (PARTITION BY sample_id ORDER BY p, junction_id) AS rank, count(*) OVER (PARTITION BY sample_id) AS n, CASE WHEN count(*) OVER (PARTITION BY sample_id) <= 10 THEN 0.375 ELSE 0.5 END AS a FROM pv WHERE p IS NOT NULL)", TEST_SQL)
def qq_plot_data(spark, sf_dir):
    return results.qq(tested(spark, sf_dir), ["sample_id"]).select("sample_id", "junction_id", F.col("rank").cast("long").alias("rank"), F.round("expected", 9).alias("expected"))


@query("SELECT junction_id, sample_id, row_number() OVER (PARTITION BY junction_id ORDER BY jaccard ASC NULLS FIRST, sample_id) AS rank FROM (SELECT junction_id, sample_id, round(jaccard, 9) AS jaccard FROM m)", METRICS_SQL)
def metric_rank_plot_data(spark, sf_dir):
    cells = jaccard_cells(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 9))
    return results.metric_ranks(cells, "jaccard").select("junction_id", "sample_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT (CASE WHEN v >= 8 THEN 201 ELSE floor(v / 0.04) + 1 END)::BIGINT AS bin, count(*) AS n FROM (SELECT junction_id, round(avg(ln(k + 1)), 9) AS v FROM grid GROUP BY 1) GROUP BY 1")
def expression_histogram(spark, sf_dir):
    return results.expression_histogram(cohort(spark, sf_dir).grid())


@query("SELECT x.sample_id AS a, y.sample_id AS b, round(corr(x.r, y.r), 7) AS spearman FROM rk x JOIN rk y ON x.junction_id = y.junction_id AND x.sample_id < y.sample_id GROUP BY ALL", METRICS_SQL + ", rk AS (SELECT junction_id, sample_id, rank() OVER (PARTITION BY sample_id ORDER BY v) + (count(*) OVER (PARTITION BY sample_id, v) - 1) / 2.0 AS r FROM (SELECT junction_id, sample_id, round(jaccard, 9) AS v FROM m WHERE jaccard IS NOT NULL))")
def sample_correlation(spark, sf_dir):
    cells = jaccard_cells(spark, sf_dir).select("junction_id", "sample_id", F.round("jaccard", 9).alias("v"))
    return results.sample_correlation(cells, "v").withColumn("spearman", F.round("spearman", 7))


@query("SELECT seqname, start, sample_id, min(p) AS p FROM pv GROUP BY ALL", TEST_SQL)
def manhattan_plot_data(spark, sf_dir):
    return results.manhattan(tested(spark, sf_dir)).select("seqname", "start", "sample_id", "p")


#: Acceptors' nations have exons behind them, and introns from these exons to the next acceptor; donors have exons before them.
CHAIN_SQL = ANN_SQL + """,
xe AS (SELECT 'chr' || c AS seqname, 20001 + 300 * n_nationkey AS start, 20060 + 300 * n_nationkey + 10 * (n_nationkey % 5) AS "end", '*' AS strand FROM nation, range(1, 4) r(c) UNION SELECT seqname, start - 100, start - 1, '*' FROM junctions),
xi AS (SELECT seqname, start, "end", strand, median_count FROM intr UNION ALL SELECT 'chr' || c, 20061 + 300 * n_nationkey + 10 * (n_nationkey % 5), 20300 + 300 * n_nationkey, '*', n_regionkey FROM nation, range(1, 4) r(c)),
ka AS (SELECT j.junction_id, j.seqname, j.start, j."end", j.strand, CASE WHEN bool_or(i.start = j.start AND i."end" = j."end") THEN 'both' WHEN bool_or(i.start = j.start) THEN 'start' WHEN bool_or(i."end" = j."end") THEN 'end' ELSE 'none' END AS annotated
  FROM junctions j LEFT JOIN xi i ON i.seqname = j.seqname AND (i.strand = j.strand OR i.strand = '*') AND i.start <= j."end" AND i."end" >= j.start GROUP BY ALL),
co AS (SELECT k.junction_id, k.seqname, k.start, k."end", k.strand, k.annotated, arg_min({a: i.start, b: i."end"}, (-i.median_count, i.start, i."end")) AS i FROM ka k JOIN xi i ON i.seqname = k.seqname AND (i.strand = k.strand OR i.strand = '*')
  AND CASE k.annotated WHEN 'start' THEN i.start = k.start WHEN 'end' THEN i."end" = k."end" ELSE i.start <= k."end" AND i."end" >= k.start END WHERE k.annotated <> 'both' GROUP BY ALL),
si AS (SELECT junction_id, 'right' AS side, seqname, strand, start AS s, "end" AS e, i.b AS far FROM co WHERE annotated <> 'end' UNION ALL SELECT junction_id, 'left', seqname, strand, -"end", -start, -i.a FROM co WHERE annotated <> 'start'),
ex2 AS (SELECT 'right' AS side, seqname, start AS s, "end" AS e FROM xe UNION ALL SELECT 'left', seqname, -"end", -start FROM xe),
in2 AS (SELECT 'right' AS side, seqname, start AS s, "end" AS e, strand, median_count FROM xi UNION ALL SELECT 'left', seqname, -"end", -start, strand, median_count FROM xi),
fo AS (SELECT si.*, max(x.e) AS ee, count(DISTINCT x.e) AS ne FROM si LEFT JOIN ex2 x ON x.side = si.side AND x.seqname = si.seqname AND x.s = si.far + 1 AND si.far < si.e GROUP BY ALL),
nx AS (SELECT fo.junction_id, fo.side, arg_min(i.e, (-i.median_count, i.e)) AS ne FROM fo JOIN in2 i ON i.side = fo.side AND i.seqname = fo.seqname AND i.s = fo.ee + 1 AND (i.strand = fo.strand OR i.strand = '*') WHERE fo.ne = 1 AND fo.ee < fo.e GROUP BY ALL),
ef AS (SELECT fo.junction_id, fo.side, far, fo.e, ee, nx.ne AS nend, CASE WHEN far > fo.e THEN 'exonElongation' WHEN ee > fo.e THEN 'exonTruncation' WHEN nx.ne >= fo.e AND NOT EXISTS (SELECT 1 FROM ex2 x WHERE x.side = fo.side AND x.seqname = fo.seqname AND x.s >= fo.s AND x.e <= far)
  AND NOT EXISTS (SELECT 1 FROM ex2 x WHERE x.side = fo.side AND x.seqname = fo.seqname AND x.s > ee AND x.e <= nx.ne) THEN 'singleExonSkipping' ELSE 'exonSkipping' END AS effect FROM fo LEFT JOIN nx ON nx.junction_id = fo.junction_id AND nx.side = fo.side),
sh AS (SELECT junction_id, effect, CASE effect WHEN 'exonSkipping' THEN 0 WHEN 'singleExonSkipping' THEN far - ee + nend - e ELSE far - e END AS shift FROM ef),
me AS (SELECT junction_id, min(effect) AS lo, max(effect) AS hi, count(*) AS m, CASE WHEN sum(shift) % 3 = 0 THEN 'unlikely' ELSE 'likely' END AS frame, bool_or(effect = 'exonSkipping') OR count(*) FILTER (effect = 'singleExonSkipping') = 2 AS unclear FROM sh GROUP BY 1)"""


@query(
    """SELECT ka.junction_id, CASE WHEN m IS NULL THEN 'noOverlap' WHEN unclear THEN 'exonSkipping' WHEN hi = 'singleExonSkipping' THEN hi WHEN lo = hi THEN lo ELSE 'exonTruncation&Elongation' END AS effect, CASE WHEN m IS NULL OR unclear THEN 'inconclusive' ELSE frame END AS frameshift
FROM ka LEFT JOIN me USING (junction_id) WHERE annotated <> 'both'""",
    CHAIN_SQL,
)
def exon_chain_impact(spark, sf_dir):
    """What junctions without a whole known intron do to the exons at their ends."""
    ds = cohort(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_regionkey", (300 * F.col("n_nationkey")).alias("at"), (60 + 10 * (F.col("n_nationkey") % 5)).alias("size"), F.explode(F.array(*[F.lit(f"chr{c}") for c in (1, 2, 3)])).alias("seqname"), F.lit("*").alias("strand"))
    exons = nation.select("seqname", (20_001 + F.col("at")).alias("start"), (20_000 + F.col("at") + F.col("size")).alias("end"), "strand")
    exons = exons.unionByName(ds.junctions.select("seqname", (F.col("start") - 100).alias("start"), (F.col("start") - 1).alias("end"), F.lit("*").alias("strand")).distinct())
    leading = nation.select("seqname", (20_001 + F.col("at") + F.col("size")).alias("start"), (20_300 + F.col("at")).alias("end"), "strand", F.col("n_regionkey").cast("double").alias("median_count"))
    introns = reference_introns(spark, sf_dir, ds).select("seqname", "start", "end", "strand", "median_count").unionByName(leading)
    known = annotation.known_ends(ds.junctions, introns)
    label = F.when(F.col("known_intron"), "both").when(F.col("known_start"), "start").when(F.col("known_end"), "end").otherwise("none")
    return exonchain.chain_impact(ds.junctions.join(known, "junction_id").withColumn("annotated", label), introns, exons)
