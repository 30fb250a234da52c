"""Sources and sinks: count tables, BED and GFF files, alignments, and saved datasets."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..dataset import SpliceDataset
from . import shared

TABLES = ("samples", "junctions", "sites", "j_counts", "ss_counts")


def read_count_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """One long table of tab-separated count files by sample_id (seqname, start, end, strand, count), read in one scan; no files give no rows."""
    schema = "seqname string, start int, end int, strand string, count long"
    if not files:
        return spark.createDataFrame([], "seqname string, start int, end int, strand string, k long, sample_id string")
    names = spark.createDataFrame([(path.rsplit("/", 1)[-1], sample) for sample, path in files.items()], "_file string, sample_id string")
    if names.select("_file").distinct().count() < len(files):
        raise ValueError("count files must have different names")
    rows = spark.read.csv(list(files.values()), sep="\t", header=True, schema=schema).withColumn("_file", F.element_at(F.split(F.url_decode(F.input_file_name()), "/"), -1))
    return rows.join(F.broadcast(names), "_file").drop("_file").withColumnRenamed("count", "k")


def from_wide(df: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    """A column for each sample to one row for each sample."""
    return df.unpivot(ids, samples, "sample_id", "k")


def dataset_from_wide(samples: DataFrame, junctions: DataFrame, sites: DataFrame, name: str = "dataset") -> SpliceDataset:
    """A dataset of two wide tables: ranges, start_id and end_id (sites: site_id and type), and a column of counts for each sample of ``samples``."""
    names = [str(r.sample_id) for r in samples.select("sample_id").collect()]  # one row for each sample
    need = {"junctions": ["seqname", "start", "end", "start_id", "end_id"], "sites": ["seqname", "start", "end", "site_id", "type"]}
    for which, table in (("junctions", junctions), ("sites", sites)):
        if missing := [c for c in (*need[which], *names) if c not in table.columns]:
            raise ValueError(f"{which} must have the columns {missing}")
    stranded = lambda t: t if "strand" in t.columns else t.withColumn("strand", F.lit("*"))
    junctions, sites = stranded(junctions), stranded(sites)
    junctions = junctions.withColumn("junction_id", F.concat_ws(":", "seqname", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")), "strand"))
    cells = from_wide(junctions, ["junction_id"], names).filter("k > 0").withColumn("k", F.col("k").cast("long"))
    site_cells = from_wide(sites, ["site_id"], names).filter("k > 0").withColumn("k", F.col("k").cast("long"))
    kept = samples.withColumn("sample_id", F.col("sample_id").cast("string"))
    return SpliceDataset(kept, junctions.select("junction_id", "seqname", "start", "end", "strand", "start_id", "end_id"), sites.select("site_id", "seqname", "start", "end", "strand", "type"), cells, site_cells, name=name).checked()


def write_counts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED regions as 1-based ranges with both ends included."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="seqname string, start0 int, end int, name string")
    return raw.select("seqname", (F.col("start0") + 1).alias("start"), "end", "name")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF or GTF features with gene and transcript ids from the attributes."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string")

    def attribute(name: str):
        return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{re.escape(name)}[ =]"?([^";]+)', 1), F.lit(""))

    return raw.select("seqname", "feature", "start", "end", "strand", attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"), attribute("gene_name").alias("symbol"))


def cigar_introns(pos: Column, cigar: Column) -> Column:
    """start and end of the introns of a CIGAR string whose first base stands at ``pos``."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    length = lambda o: F.regexp_extract(o, r"^(\d+)", 1).cast("int")
    uses = lambda o: F.when(F.right(o, F.lit(1)).isin("M", "D", "N", "=", "X"), length(o)).otherwise(0)
    start = F.struct(pos.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    step = lambda a, o: F.struct((a["at"] + uses(o)).alias("at"), F.when(F.right(o, F.lit(1)) == "N", F.array_append(a["found"], F.struct(a["at"].alias("start"), (a["at"] + length(o) - 1).alias("end")))).otherwise(a["found"]).alias("found"))
    return F.aggregate(ops, start, step)["found"]


def alignment_introns(alignments: DataFrame) -> DataFrame:
    """(read_id, sample_id, seqname, start, end, strand) of the introns of CIGAR strings; pos is the 1-based first base."""
    found = alignments.select("read_id", "sample_id", "seqname", "strand", F.explode(cigar_introns(F.col("pos"), F.col("cigar"))).alias("i"))
    return found.select("read_id", "sample_id", "seqname", "i.start", "i.end", "strand")


def split_counts(alignments: DataFrame) -> DataFrame:
    """Distinct fragments for each junction and sample."""
    return alignment_introns(alignments).groupBy("sample_id", "seqname", "start", "end", "strand").agg(F.count_distinct("read_id").alias("k"))


def save(ds: SpliceDataset, path: str, rewrite: bool = True, keep_old: bool = False) -> None:
    """All tables below a folder of their own, then the manifest that names it: a reader sees the old dataset or the new one, never a mixture.

    The version that the manifest named before goes at the end, unless it is to be kept for those who still read it; ``ds`` may be read from it.
    """
    spark = ds.samples.sparkSession
    old = _manifest(spark, path)
    if old and not rewrite:
        raise FileExistsError(f"a dataset is saved at {path}")
    version = uuid.uuid4().hex
    for t in TABLES:
        getattr(ds, t).write.parquet(f"{path}/{version}/{t}")
    manifest = json.dumps({"name": ds.name, "version": version, "params": ds.params})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    if old and not keep_old:
        shared.delete(spark, f"{path}/{old['version']}")


def _manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/manifest").first().value) if shared.exists(spark, f"{path}/manifest") else None


def load(spark: SparkSession, path: str, name: str | None = None) -> SpliceDataset:
    """A saved dataset from wherever its folder lies now, with its name and parameters."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no dataset is saved at {path}")
    return SpliceDataset(**{t: spark.read.parquet(f"{path}/{manifest['version']}/{t}") for t in TABLES}, name=name or manifest["name"], params=manifest["params"])


def is_saved(spark: SparkSession, path: str, samples: DataFrame) -> bool:
    """Whether a dataset of all these samples is saved at ``path``, so that nothing needs to be counted again."""
    if _manifest(spark, path) is None:
        return False
    return samples.select(F.col("sample_id").cast("string")).join(load(spark, path).samples.select(F.col("sample_id").cast("string")), "sample_id", "left_anti").isEmpty()


def save_filtered(ds: SpliceDataset, judged: DataFrame, path: str, flag: str = "passed") -> SpliceDataset:
    """The dataset of the junctions that passed; the counts of the others are added to those saved at ``path`` before."""
    out = judged.filter(~F.coalesce(F.col(flag), F.lit(False))).select("junction_id")
    kept = ds.subset(junctions=judged.filter(F.col(flag)))
    lost = {
        "junctions": ds.junctions.join(out, "junction_id", "left_semi"),
        "j_counts": ds.j_counts.join(out, "junction_id", "left_semi"),
        # sites that no junction kept touches, and their nonsplit reads
        "sites": ds.sites.join(kept.sites.select("site_id"), "site_id", "left_anti"),
        "ss_counts": ds.ss_counts.join(kept.sites.select("site_id"), "site_id", "left_anti"),
    }
    for name, rows in lost.items():
        rows.write.mode("append").parquet(f"{path}/{name}")
    return kept


def with_filtered(ds: SpliceDataset, path: str) -> SpliceDataset:
    """The dataset with the junctions, their sites and the counts of both that filters have saved at ``path``, to be filtered anew."""
    spark = ds.samples.sparkSession
    rest, counts, sites, site_counts = (spark.read.parquet(f"{path}/{name}") for name in ("junctions", "j_counts", "sites", "ss_counts"))
    new = rest.join(ds.junctions.select("junction_id"), "junction_id", "left_anti").dropDuplicates(["junction_id"])
    counts = counts.join(new.select("junction_id"), "junction_id", "left_semi").dropDuplicates(["junction_id", "sample_id"])
    at = ["site_id", "seqname", "start", "end", "strand"]
    new_sites = sites.join(ds.sites.select("site_id"), "site_id", "left_anti").dropDuplicates(at)
    site_counts = site_counts.join(new_sites.select("site_id"), "site_id", "left_semi").dropDuplicates(["site_id", "sample_id"])
    return ds.with_(junctions=ds.junctions.unionByName(new), j_counts=ds.j_counts.unionByName(counts), sites=ds.sites.unionByName(new_sites), ss_counts=ds.ss_counts.unionByName(site_counts))


def gene_source(genes: DataFrame) -> DataFrame:
    """Genes with a symbol: rows without one and names with ``_`` or ``.`` go; a numeric strand becomes + or -."""
    kept = genes.filter("symbol is not null and symbol <> ''").filter(~F.col("symbol").rlike("[_.]"))
    if dict(genes.dtypes)["strand"] != "string":
        kept = kept.withColumn("strand", F.when(F.col("strand") < 0, "-").otherwise("+"))
    return kept


def annotation_tables(features: DataFrame) -> dict[str, DataFrame]:
    """genes, exons, introns and UTRs by transcript from GFF features (read_gff)."""
    from ..operators.intervals import introns

    exons = features.filter("feature = 'exon'").select("transcript_id", "gene_id", "seqname", "start", "end", "strand")
    utr = lambda *names: features.filter(F.col("feature").isin(*names)).select("transcript_id", "seqname", "start", "end", "strand")
    genes = features.filter("gene_id is not null").groupBy("gene_id", "seqname", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("symbol").alias("symbol"))
    return {"genes": genes, "exons": exons, "introns": introns(exons), "five_utr": utr("five_prime_UTR", "five_prime_utr"), "three_utr": utr("three_prime_UTR", "three_prime_utr")}


def rename_chromosomes(df: DataFrame, names: DataFrame) -> DataFrame:
    """seqname by a two-column table (from_name, to_name); rows of unknown names go."""
    return df.join(names.select(F.col("from_name").alias("seqname"), "to_name"), "seqname").withColumn("seqname", F.col("to_name")).drop("to_name")
