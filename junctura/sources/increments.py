"""Counts that are kept by sample: only samples that are not there yet are read and counted.

A folder holds split counts partitioned by sample, nonsplit counts by batch and sample, and small tables that say what is done. A batch is some samples counted at some
sites. New samples can bring new sites into a dataset; samples counted before are counted at those alone, so only their alignments at new sites are asked for. What a
run that failed has written is not named in the tables of what is done, and never read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dataset import SpliceDataset
from ..operators import counting
from . import shared

#: Alignments of some samples, and of the regions (seqname, first and last base) that are asked for, where there are such.
Reader = Callable[[list, list[tuple[str, int, int]] | None], DataFrame]

SPLIT = "seqname string, start int, end int, strand string, k long"
SITE_KEYS = ["site_id", *counting.RANGE]


def table_reader(alignments: DataFrame) -> Reader:
    """A reader of a table: the samples reach its scan, and so does the part of the regions that concerns their sequences."""

    def read(samples: list, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
        own = alignments.filter(F.col("sample_id").isin(samples))
        return own if regions is None else own.filter(F.col("seqname").isin(sorted({r[0] for r in regions})))

    return read


def looks_once(read: Reader, strand_mode: int = counting.UNSTRANDED, paired: bool = True) -> Reader:
    """The fragments (counting.fragments) of what ``read`` gives; those of whole samples are written, so that split and nonsplit counts of one and the same table read it once."""
    kept: list[tuple[DataFrame, DataFrame]] = []

    def looks(samples: list, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
        rows = read(samples, regions)
        made = counting.fragments(rows, strand_mode, paired)
        if regions is not None:
            return made
        for before, written in kept:
            if before.sameSemantics(rows):
                return written
        kept.append((rows, shared.written(made, "fragments")))
        return kept[-1][1]

    return looks


def file_reader(spark: SparkSession, path: str) -> Reader:
    """A reader of a folder of BAM files; files of other samples are not opened but for their headers, other regions not decoded."""
    from . import bam

    return lambda samples, regions=None: bam.read_alignments(spark, path, samples=[str(s) for s in samples], regions=regions)


def _column(spark: SparkSession, path: str, *names: str) -> list:
    """The rows of a small table, none where it is not there."""
    return [tuple(r) for r in spark.read.parquet(path).select(*names).distinct().collect()] if shared.exists(spark, path) else []


def _regions(sites: DataFrame, margin: int, most: int = 10_000) -> list[tuple[str, int, int]] | None:
    """The stretches around sites, those near each other as one; a stretch for each sequence where they are more than ``most``."""
    tile = 1 << 20
    tiles = sites.groupBy("seqname", F.floor(F.col("start") / tile).alias("tile")).agg(F.min("start").alias("low"), F.max("end").alias("high"))
    whole = sites.groupBy("seqname").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    few = tiles.limit(most + 1).collect()
    rows = few if len(few) <= most else whole.collect()  # one row for each sequence
    return sorted((r.seqname, max(r.low - margin, 1), r.high + margin) for r in rows)


def split_by_sample(spark: SparkSession, read: Reader, samples: Sequence, path: str, strand_mode: int = counting.UNSTRANDED, paired: bool = True, recount: Sequence = (), looks: Reader | None = None) -> DataFrame:
    """sample_id, range and k of the samples, of which only absent ones and those of ``recount`` are counted, from ``looks`` where it is given; all others come from ``path``."""
    done = {r[0] for r in _column(spark, f"{path}/split-done", "sample_id")}
    absent = [s for s in samples if s not in done or s in set(recount)]
    if absent:
        for s in absent:  # a sample without split reads leaves no partition that could replace an old one
            shared.delete(spark, f"{path}/split/sample_id={s}")
        counts = counting.split_of(looks(absent, None), paired) if looks else counting.split_counts(read(absent, None), strand_mode, paired)
        kind = counts.schema["sample_id"].dataType.simpleString()
        counts.write.partitionBy("sample_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/split")
        spark.createDataFrame([(s,) for s in absent], f"sample_id {kind}").write.mode("append").parquet(f"{path}/split-done")
    kind = spark.read.parquet(f"{path}/split-done").schema["sample_id"].dataType.simpleString()
    found = spark.read.schema(f"{SPLIT}, sample_id {kind}").parquet(f"{path}/split")
    return found.filter(F.col("sample_id").isin(list(samples))).select("sample_id", *counting.RANGE, "k")


def nonsplit_by_sample(spark: SparkSession, read: Reader, samples: Sequence, sites: DataFrame, path: str, min_anchor: int = 5, strand_mode: int = counting.UNSTRANDED, recount: Sequence = (), paired: bool = True, looks: Reader | None = None) -> DataFrame:
    """site_id, sample_id and k of the samples at ``sites``; a sample is counted only at sites where it was not before, from ``looks`` where it is given."""
    looks = looks or looks_once(read, strand_mode, paired)
    again = set(recount)
    rows = sorted(_column(spark, f"{path}/batches", "number", "fresh", "batch", "sample_id"), key=lambda r: r[0])
    batches: dict = defaultdict(set)
    for _, fresh, batch, sample in rows:  # a fresh count replaces those before
        batches[sample] = {batch} if fresh else batches[sample] | {batch}
    number = rows[-1][0] + 1 if rows else 0
    groups: dict[frozenset, list] = defaultdict(list)
    for s in samples:
        groups[frozenset() if s in again else frozenset(batches[s])].append(s)
    used: dict = {s: set(b) for b, own in groups.items() for s in own}
    kind = None
    for known, own in groups.items():  # as many as there were runs, at most
        missing = sites.select(*SITE_KEYS).distinct()
        if known:
            before = spark.read.parquet(f"{path}/sites").filter(F.col("batch").isin(sorted(known)))
            missing = missing.join(before.select("site_id"), "site_id", "left_anti")
        missing = shared.written(missing, "missing-sites")
        if missing.isEmpty():
            continue
        batch = uuid.uuid4().hex
        regions = _regions(missing, min_anchor + 1) if known else None
        counts = counting.nonsplit_of(looks(own, regions), missing, min_anchor)
        kind = counts.schema["sample_id"].dataType.simpleString()
        counts.write.parquet(f"{path}/nonsplit/batch={batch}")
        missing.write.parquet(f"{path}/sites/batch={batch}")
        spark.createDataFrame([(number, not known, batch, s) for s in own], f"number long, fresh boolean, batch string, sample_id {kind}").write.mode("append").parquet(f"{path}/batches")
        number += 1
        for s in own:
            used[s].add(batch)
    if not any(used.values()):
        return spark.createDataFrame([], "site_id string, sample_id string, k long")
    kind = kind or spark.read.parquet(f"{path}/batches").schema["sample_id"].dataType.simpleString()
    pairs = spark.createDataFrame([(b, s) for s, own in used.items() for b in own], f"batch string, sample_id {kind}")
    all_batches = sorted({b for own in used.values() for b in own})
    found = spark.read.schema(f"site_id string, sample_id {kind}, k long, batch string").parquet(f"{path}/nonsplit").filter(F.col("batch").isin(all_batches))
    return found.join(F.broadcast(pairs), ["batch", "sample_id"]).join(sites.select("site_id").distinct(), "site_id", "left_semi").select("site_id", "sample_id", "k")


def count_samples(
    spark: SparkSession, read: Reader, samples: DataFrame, path: str, strand_mode: int = counting.UNSTRANDED, paired: bool = True, min_anchor: int = 5, min_expression: int | None = 20, recount: Sequence = ()
) -> SpliceDataset:
    """The dataset of ``samples`` (sample_id and more), with what ``path`` has of them reused; equal to a count of all of them at once."""
    ids = [r.sample_id for r in samples.select("sample_id").sort("sample_id").collect()]  # one row for each sample
    with shared.scratch():
        looks = looks_once(read, strand_mode, paired)
        split = split_by_sample(spark, read, ids, path, strand_mode, paired, recount, looks)
        if min_expression is not None:
            split = split.join(counting.expressed(split, min_expression), counting.RANGE, "left_semi")
        ds = counting.assembled(samples, split)
        return ds.with_(ss_counts=nonsplit_by_sample(spark, read, ids, ds.sites, path, min_anchor, strand_mode, recount, paired, looks))


def forget_samples(spark: SparkSession, path: str) -> None:
    """Deletes all counts that are kept below ``path``."""
    for name in ("split", "split-done", "nonsplit", "sites", "batches"):
        shared.delete(spark, f"{path}/{name}")
