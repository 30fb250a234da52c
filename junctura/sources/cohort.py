"""A cohort of samples and junctions projected from the order tables.

A nation of customers is a sample, a brand a donor site, a nation of suppliers an acceptor site: a
finished line is a split read of its junction, a returned open line a nonsplit read at both of its sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dataset import SpliceDataset
from . import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    line = line.filter("l_linestatus = 'F' or (l_linestatus = 'O' and l_returnflag = 'R')")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sample_id"))
    part = table(spark, sf_dir, "part").select("p_partkey", (F.substring("p_brand", 7, 4).cast("int") - 1).alias("donor"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("acceptor"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    # counted once for both kinds of reads: what follows works on cells, not on lines
    return joined.groupBy("sample_id", "donor", "acceptor").agg(F.count_if(F.col("l_linestatus") == "F").alias("split"), F.count_if(F.col("l_linestatus") == "O").alias("nonsplit"))


def _place(df: DataFrame) -> DataFrame:
    return df.withColumns({"seqname": F.concat(F.lit("chr"), F.col("donor") % 3 + 1), "start": 1000 + 400 * F.col("donor"), "end": 20000 + 300 * F.col("acceptor"), "strand": F.when(F.col("donor") % 2 == 0, "+").otherwise("-")})


_cells: dict[tuple[str, str], DataFrame] = {}


def _written_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted cells, written once for each application and path: all tables of a cohort derive from them, not from the lines again.

    They are as many as samples x junctions, whatever the number of lines. A path is taken to hold the same rows while the application runs;
    ``forget`` drops what is kept.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cells:
        _cells[key] = shared.written(_reads(spark, sf_dir), "cohort-cells")
    return _cells[key]


def forget() -> None:
    """Counts anew from here on."""
    _cells.clear()
    _kept.clear()


_kept: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What ``make`` gives for a path, written once for each application: queries that share it do not derive it again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = shared.written(make(spark, sf_dir), name)
    return _kept[key]


def jaccard_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratios of every junction and sample of the cohort."""
    from ..operators import metrics

    return once(spark, sf_dir, "jaccard-cells", lambda s, d: metrics.intron_jaccard(cohort(s, d)))


def cohort(spark: SparkSession, sf_dir: str) -> SpliceDataset:
    cells = _written_cells(spark, sf_dir)
    split = cells.filter("split > 0")
    ids = {"start_id": F.col("donor").cast("long"), "end_id": (1000 + 25 * (F.col("donor") % 6) + F.col("acceptor")).cast("long"), "junction_id": (F.col("donor") * 25 + F.col("acceptor")).cast("long")}
    junctions = _place(split.select("donor", "acceptor").distinct()).withColumns(ids).select("junction_id", "seqname", "start", "end", "strand", "start_id", "end_id")
    left = junctions.select(F.col("start_id").alias("site_id"), "seqname", (F.col("start") - 1).alias("s"), F.col("start").alias("e"), "strand", F.when(F.col("strand") == "-", "Acceptor").otherwise("Donor").alias("type"))
    right = junctions.select(F.col("end_id").alias("site_id"), "seqname", F.col("end").alias("s"), (F.col("end") + 1).alias("e"), "strand", F.when(F.col("strand") == "-", "Donor").otherwise("Acceptor").alias("type"))
    sites = left.union(right).distinct().withColumnsRenamed({"s": "start", "e": "end"})
    j_counts = split.select((F.col("donor") * 25 + F.col("acceptor")).cast("long").alias("junction_id"), "sample_id", F.col("split").alias("k"))
    open_ = cells.filter("nonsplit > 0")
    ends = open_.select(F.explode(F.array(ids["start_id"], ids["end_id"])).alias("site_id"), "sample_id", "nonsplit")
    ss_counts = ends.groupBy("site_id", "sample_id").agg(F.sum("nonsplit").alias("k")).join(sites.select("site_id"), "site_id", "left_semi")
    samples = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample_id"), F.col("n_name").alias("name"), (F.col("n_regionkey")).cast("string").alias("condition"))
    return SpliceDataset(samples, junctions, sites, j_counts, ss_counts, name="cohort")


#: The same projection in DuckDB SQL: samples, junctions, sites, jc, sc, grid, sgrid.
COHORT_SQL = """
reads AS (SELECT c_nationkey AS sample_id, substr(p_brand, 7)::INT - 1 AS donor, s_nationkey AS acceptor,
  count(*) FILTER (l_linestatus = 'F') AS split, count(*) FILTER (l_linestatus = 'O') AS nonsplit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_linestatus = 'F' OR (l_linestatus = 'O' AND l_returnflag = 'R') GROUP BY ALL),
samples AS (SELECT n_nationkey AS sample_id, n_name AS name, n_regionkey::VARCHAR AS condition FROM nation),
junctions AS (SELECT DISTINCT donor * 25 + acceptor AS junction_id, 'chr' || (donor % 3 + 1) AS seqname, 1000 + 400 * donor AS start, 20000 + 300 * acceptor AS "end", CASE WHEN donor % 2 = 0 THEN '+' ELSE '-' END AS strand, donor AS start_id, 1000 + 25 * (donor % 6) + acceptor AS end_id FROM reads WHERE split > 0),
sites AS (SELECT DISTINCT start_id AS site_id, seqname, start - 1 AS start, start AS "end", strand, CASE WHEN strand = '-' THEN 'Acceptor' ELSE 'Donor' END AS type FROM junctions
  UNION SELECT DISTINCT end_id, seqname, "end", "end" + 1, strand, CASE WHEN strand = '-' THEN 'Donor' ELSE 'Acceptor' END FROM junctions),
jc AS (SELECT donor * 25 + acceptor AS junction_id, sample_id, split AS k FROM reads WHERE split > 0),
sc AS (SELECT site_id, sample_id, sum(nonsplit)::BIGINT AS k FROM (SELECT donor AS site_id, sample_id, nonsplit FROM reads WHERE nonsplit > 0 UNION ALL SELECT 1000 + 25 * (donor % 6) + acceptor, sample_id, nonsplit FROM reads WHERE nonsplit > 0) WHERE site_id IN (SELECT site_id FROM sites) GROUP BY ALL),
grid AS (SELECT j.*, s.sample_id, coalesce(k, 0) AS k FROM junctions j CROSS JOIN samples s LEFT JOIN jc ON jc.junction_id = j.junction_id AND jc.sample_id = s.sample_id),
sgrid AS (SELECT t.*, s.sample_id, coalesce(k, 0) AS k FROM sites t CROSS JOIN samples s LEFT JOIN sc ON sc.site_id = t.site_id AND sc.sample_id = s.sample_id)
"""
