"""The corpus pipeline: quality, similar lines, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes to the shared
folder and reads again as the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_classifier, text as tx

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share at least this percentage of their five-word shingles.
WIDTH, SIMILAR = 5, 80
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch at most. Documents have kilobytes, and a batch lies in the executor and in its Python worker, for each task.
BATCH_ROWS = 1_000


def _checked(ids: DataFrame) -> DataFrame:
    """Ids, broadcast only up to a number that is counted first."""
    ids = tx.written(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller number stays. It stays set, as a stage runs after its function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    _bounded_batches(spark)
    return quality_classifier.score_documents(docs, tx.table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are similar to an earlier one, short lines included; no document goes."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    _bounded_batches(spark)
    found = jaccard_join.jaccard_components(docs, WIDTH, SIMILAR, 100)
    return docs.join(_checked(found.filter("doc_id <> component_id").select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    _bounded_batches(spark)
    hits = decontaminate.contained_items(docs, tx.table(spark, sf_dir, "benchmark"))
    return docs.join(_checked(hits.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and digests of the ids and of the text that they decode to."""
    _bounded_batches(spark)
    return bpe.encoded_documents(docs, bpe.tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]
#: SQL cannot express the first stage; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tx.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tx.written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
