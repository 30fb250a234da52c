"""From alignments to a dataset: chromosomes, introns, splice sites, split and nonsplit counts.

An alignment is a row of sample_id, read_id (that of the pair for paired reads), seqname, pos (1-based), cigar and strand, and
where there are such mapq and mate (1 or 2). Alignments come as a table of any number of samples; nothing is done sample by sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..dataset import SpliceDataset
from ..sources import shared
from ..sources.files import cigar_introns
from . import intervals

UNSTRANDED, FORWARD, REVERSE = 0, 1, 2
RANGE = ["seqname", "start", "end", "strand"]


def mapped_chromosomes(alignments: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """sample_id, seqname and number of alignments of the chromosomes that have some, with their length where ``lengths`` (seqname, length) knows it."""
    out = alignments.groupBy("sample_id", "seqname").agg(F.count(F.lit(1)).alias("n"))
    return out if lengths is None else out.join(lengths.select("seqname", "length"), "seqname", "left")


def restricted(alignments: DataFrame, chromosomes: Sequence[str] | None = None, min_mapq: int | None = None) -> DataFrame:
    """Alignments of some chromosomes and of a mapping quality at least; both conditions reach the scan."""
    out = alignments
    if chromosomes is not None:
        out = out.filter(F.col("seqname").isin(list(chromosomes)))
    return out if min_mapq is None else out.filter(F.col("mapq") >= min_mapq)


def fragment_strand(alignments: DataFrame, strand_mode: int) -> Column:
    """``*`` without strand information; else that of the first mate, or its opposite if the library is reversed."""
    if strand_mode == UNSTRANDED:
        return F.lit("*")
    flipped = F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+").otherwise(F.col("strand"))
    turn = F.lit(strand_mode == REVERSE)
    if "mate" in alignments.columns:
        turn = F.coalesce(F.col("mate") == 2, F.lit(False)) != turn
    return F.when(turn, flipped).otherwise(F.col("strand"))


def fragments(alignments: DataFrame, strand_mode: int = UNSTRANDED, paired: bool = True) -> DataFrame:
    """What fragments look like on a sequence, and how many of a sample look so: sample_id, seqname, parts (strand, pos and cigar of the distinct alignments), n and named (those that have a read_id).

    Unpaired reads are fragments one by one, those of one name or in repeated rows as well. CIGARs are parsed, and sites looked up, once for each look and not for each read.
    """
    part = F.struct(fragment_strand(alignments, strand_mode).alias("strand"), F.col("pos").cast("int").alias("pos"), "cigar")
    rows = alignments.filter("pos is not null and cigar is not null").select("sample_id", "read_id", "seqname", part.alias("part"))
    if not paired:
        looks = rows.groupBy("sample_id", "seqname", "part").agg(F.count(F.lit(1)).alias("n"))
        return looks.select("sample_id", "seqname", F.array("part").alias("parts"), "n", F.col("n").alias("named"))
    whole = rows.groupBy("sample_id", "read_id", "seqname").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    return whole.groupBy("sample_id", "seqname", "parts").agg(F.count(F.lit(1)).alias("n"), F.count("read_id").alias("named"))


def split_of(looks: DataFrame, paired: bool = True) -> DataFrame:
    """The split counts of ``fragments``."""
    introns = F.flatten(F.transform("parts", lambda p: F.transform(cigar_introns(p["pos"], p["cigar"]), lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), p["strand"].alias("strand")))))
    found = looks.select("sample_id", "seqname", "named", F.explode(F.array_distinct(introns) if paired else introns).alias("i"))
    return found.select("sample_id", "seqname", "i.*", "named").groupBy("sample_id", *RANGE).agg(F.sum("named").alias("k"))


def split_counts(alignments: DataFrame, strand_mode: int = UNSTRANDED, paired: bool = True) -> DataFrame:
    """sample_id, range and k: fragments that span each junction. Unpaired reads count one by one, mates of a pair together."""
    return split_of(fragments(alignments.filter(F.col("cigar").contains("N")), strand_mode, paired), paired)


def with_motif_strand(counts: DataFrame, motifs: DataFrame) -> DataFrame:
    """Unstranded junctions get the strand of the motif at their ends (seqname, start, end, strand), ``+`` where it is not known."""
    known = motifs.select("seqname", "start", "end", F.col("strand").alias("_motif")).dropDuplicates(["seqname", "start", "end"])
    out = counts.join(known, ["seqname", "start", "end"], "left")
    return out.withColumn("strand", F.when(F.col("strand") == "*", F.when(F.col("_motif").isin("+", "-"), F.col("_motif")).otherwise("+")).otherwise(F.col("strand"))).drop("_motif")


def expressed(counts: DataFrame, min_expression: int = 20, keys: Sequence[str] = RANGE) -> DataFrame:
    """The junctions that some sample has ``min_expression`` reads of."""
    return counts.groupBy(*keys).agg(F.max("k").alias("max_count")).filter(F.col("max_count") >= min_expression).select(*keys)


def site_coordinates(junctions: DataFrame) -> DataFrame:
    """The distinct sites of junctions: two bases at each end; on the reverse strand the donor is at the right."""
    minus = F.col("strand") == "-"
    left = F.struct((F.col("start") - 1).alias("start"), F.col("start").alias("end"), F.when(minus, "Acceptor").otherwise("Donor").alias("type"))
    right = F.struct(F.col("end").alias("start"), (F.col("end") + 1).alias("end"), F.when(minus, "Donor").otherwise("Acceptor").alias("type"))
    return junctions.select("seqname", "strand", F.explode(F.array(left, right)).alias("s")).select("seqname", "s.start", "s.end", "strand", "s.type").distinct()


def range_id(start: Column, end: Column) -> Column:
    """An identity of a range that needs no numbering: what it is."""
    return F.concat_ws(":", "seqname", F.concat_ws("-", start.cast("string"), end.cast("string")), "strand")


def with_site_ids(junctions: DataFrame) -> DataFrame:
    """``junctions`` with junction_id, start_id and end_id from their coordinates."""
    s, e = F.col("start"), F.col("end")
    return junctions.withColumns({"junction_id": range_id(s, e), "start_id": range_id(s - 1, s), "end_id": range_id(e, e + 1)})


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """start and end of the stretches of an alignment between its introns."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    length = lambda o: F.regexp_extract(o, r"^(\d+)", 1).cast("int")
    kind = lambda o: F.right(o, F.lit(1))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(pos.cast("int").alias("at"), pos.cast("int").alias("since"), empty.alias("found"))
    close = lambda a: F.when(a["at"] > a["since"], F.array_append(a["found"], F.struct(a["since"].alias("start"), (a["at"] - 1).alias("end")))).otherwise(a["found"])
    step = lambda a, o: (
        F.when(kind(o) == "N", F.struct((a["at"] + length(o)).alias("at"), (a["at"] + length(o)).alias("since"), close(a).alias("found")))
        .when(kind(o).isin("M", "D", "=", "X"), F.struct((a["at"] + length(o)).alias("at"), a["since"].alias("since"), a["found"].alias("found")))
        .otherwise(F.struct(a["at"].alias("at"), a["since"].alias("since"), a["found"].alias("found")))
    )
    return F.aggregate(ops, start, step, close)


def alignment_blocks(alignments: DataFrame, *also: str) -> DataFrame:
    """The stretches of an alignment between its introns: read_id, sample_id, seqname, strand, start, end, the stretch's number (block) and the columns ``also``."""
    kept = ["read_id", "sample_id", "seqname", "strand", *also]
    return alignments.select(*kept, F.posexplode(cigar_blocks(F.col("pos"), F.col("cigar"))).alias("block", "b")).select(*kept, "b.start", "b.end", "block")


def stretches(looks: DataFrame, reach: Column) -> DataFrame:
    """sample_id, seqname, blocks (start, end, strand), start, end and n: what fragments cover, cut where no window of ``reach`` bases meets both sides.

    Bases that both mates have are there once, so fragments that cover the same have the same blocks; a window meets one stretch of a fragment at most.
    """
    block = "struct<start:int,end:int,strand:string>"
    blocks = F.flatten(F.transform("parts", lambda p: F.transform(cigar_blocks(p["pos"], p["cigar"]), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), p["strand"].alias("strand")))))
    none = F.struct(F.array().alias("done"), F.array().alias("open"), F.lit(0).alias("upto")).cast(f"struct<done:array<array<{block}>>,open:array<{block}>,upto:int>")
    last = lambda a: F.element_at(a["open"], -1)
    longer = lambda a, x: F.array_append(F.slice(a["open"], 1, F.size(a["open"]) - 1), F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"), x["strand"].alias("strand")))
    step = lambda a, x: (
        F.when((F.size(a["open"]) == 0) | (x["start"] - a["upto"] >= reach), F.struct(F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.array_append(a["done"], a["open"])).alias("done"), F.array(x).alias("open"), x["end"].alias("upto")))
        .when(last(a)["strand"].eqNullSafe(x["strand"]) & (x["start"] <= last(a)["end"] + 1), F.struct(a["done"].alias("done"), longer(a, x).alias("open"), F.greatest(a["upto"], x["end"]).alias("upto")))
        .otherwise(F.struct(a["done"].alias("done"), F.array_append(a["open"], x).alias("open"), F.greatest(a["upto"], x["end"]).alias("upto")))
    )
    cut = F.aggregate(F.sort_array(F.filter(blocks, lambda b: b["start"].isNotNull())), none, step, lambda a: F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    found = looks.select("sample_id", "seqname", "n", F.explode(cut).alias("blocks")).groupBy("sample_id", "seqname", "blocks").agg(F.sum("n").alias("n"))
    return found.select("sample_id", "seqname", "blocks", F.col("blocks")[0]["start"].alias("start"), F.array_max(F.transform("blocks", lambda b: b["end"])).alias("end"), F.lit("*").alias("strand"), "n")


def nonsplit_of(looks: DataFrame, sites: DataFrame, min_anchor: int = 5, width: int = 200) -> DataFrame:
    """The nonsplit counts of ``fragments`` at ``sites``."""
    places = intervals.windows_of(sites.select("site_id", *RANGE).distinct(), min_anchor + 1)  # a site may be the donor of one junction and the acceptor of another
    widest = places.agg(F.max(F.col("end") - F.col("start") + 1).alias("_reach"))
    found = stretches(looks.crossJoin(F.broadcast(widest)), F.col("_reach"))
    pairs = intervals.overlap_narrow(found, places, width)
    lo, hi = lambda x: F.greatest(x["start"].cast("long"), F.col("b.start")), lambda x: F.least(x["end"].cast("long"), F.col("b.end"))
    fits = lambda x: (x["strand"] == F.col("b.strand")) | (x["strand"] == "*") | (F.col("b.strand") == "*")
    # blocks of both strands may overlap at a site of none
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["upto"], hi(x)).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), hi(x) - F.greatest(a["upto"], lo(x) - 1))).alias("n"))
    enough = pairs.filter(F.aggregate(F.filter("a.blocks", fits), zero, step)["n"] >= 2 * min_anchor)
    return enough.groupBy(F.col("b.site_id").alias("site_id"), F.col("a.sample_id").alias("sample_id")).agg(F.sum("a.n").alias("k"))


def nonsplit_counts(alignments: DataFrame, sites: DataFrame, min_anchor: int = 5, strand_mode: int = UNSTRANDED, width: int = 200, paired: bool = True) -> DataFrame:
    """site_id, sample_id and k: fragments with 2 min_anchor bases at least in the window around a site, which is one base wider at each side than that.

    A read that spans the junction has half of the window only; reads over several sites count at each. Mates of a pair are one fragment. Unpaired
    reads, long ones with any number of introns among them, count one by one, so alignments of one name or in repeated rows are each a read.
    """
    return nonsplit_of(fragments(alignments, strand_mode, paired), sites, min_anchor, width)


def assembled(samples: DataFrame, split: DataFrame, nonsplit: DataFrame | None = None, name: str = "dataset") -> SpliceDataset:
    """A dataset of counts by range: ``split`` (sample_id, range, k) and ``nonsplit`` (site_id, sample_id, k)."""
    junctions = with_site_ids(split.select(*RANGE).distinct()).select("junction_id", *RANGE, "start_id", "end_id")
    sites = site_coordinates(junctions).withColumn("site_id", range_id(F.col("start"), F.col("end"))).select("site_id", *RANGE, "type")
    j_counts = split.withColumn("junction_id", range_id(F.col("start"), F.col("end"))).select("junction_id", "sample_id", "k")
    ss_counts = sites.select("site_id", F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"), F.lit(0).cast("long").alias("k")).limit(0) if nonsplit is None else nonsplit.join(sites.select("site_id"), "site_id", "left_semi")
    return SpliceDataset(samples, junctions, sites, j_counts, ss_counts, name=name)


def count_dataset(alignments: DataFrame, samples: DataFrame, strand_mode: int = UNSTRANDED, paired: bool = True, min_anchor: int = 5, min_expression: int | None = 20, chromosomes: Sequence[str] | None = None, min_mapq: int | None = None) -> SpliceDataset:
    """Split reads, the junctions expressed in some sample (all with ``min_expression`` None), and nonsplit reads at their sites; single-end and long reads are not ``paired``."""
    used = restricted(alignments, chromosomes, min_mapq)
    looks = shared.written(fragments(used, strand_mode, paired), "fragments")
    split = shared.written(split_of(looks, paired), "split")
    if min_expression is not None:
        split = split.join(expressed(split, min_expression), RANGE, "left_semi")
    ds = assembled(samples, split)
    return ds.with_(ss_counts=nonsplit_of(looks, ds.sites, min_anchor))


def common_chromosome_style(names: DataFrame) -> DataFrame:
    """The most frequent style of chromosome names (seqname): UCSC with ``chr``, NCBI without; the first by name on a tie."""
    style = F.when(F.col("seqname").startswith("chr"), "UCSC").otherwise("NCBI")
    return names.groupBy(style.alias("style")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "style").limit(1)


def uniform_chromosomes(lengths: DataFrame) -> DataFrame:
    """seqname and length of the chromosomes that have one length in all samples (seqname, length, one row or more for each)."""
    return lengths.groupBy("seqname").agg(F.count_distinct("length").alias("n"), F.min("length").alias("length")).filter("n = 1").select("seqname", "length")


def merge_external(own: SpliceDataset, external: dict[str, DataFrame], annotation: DataFrame) -> tuple[SpliceDataset, DataFrame, DataFrame]:
    """Own and external samples over the ranges that both know exactly, with the other counts of both.

    ``external``: k_j, n_psi5 and n_psi3 by junction range, k_theta and n_theta (k_theta where missing) by site range, each with sample_id and its count ``k``.
    Gives the dataset and the other counts o_psi5, o_psi3 of junctions and o_theta of sites. Sites that belong to no junction left go.
    """
    missing = {"k_j", "n_psi5", "n_psi3", "k_theta"} - set(external)
    if missing:
        raise ValueError(f"external counts are missing: {sorted(missing)}")
    text = lambda df: df.withColumn("sample_id", F.col("sample_id").cast("string"))
    k_j = external["k_j"]
    both = own.junctions.join(k_j.select(*RANGE).distinct(), RANGE, "left_semi")
    given = [r.sample_id for r in text(annotation).select("sample_id").distinct().collect()]
    theirs = lambda name, rows, key: text(external[name]).filter(F.col("sample_id").isin(given)).join(rows.select(key, *RANGE), RANGE).select(key, "sample_id", F.col("k").cast("long").alias("k"))
    j_counts = text(own.j_counts).join(both.select("junction_id"), "junction_id", "left_semi").select("junction_id", "sample_id", "k").unionByName(theirs("k_j", both, "junction_id"))
    ends = both.select(F.explode(F.array("start_id", "end_id")).alias("site_id")).distinct()
    sites = own.sites.join(external["k_theta"].select(*RANGE).distinct(), RANGE, "left_semi").join(ends, "site_id", "left_semi")
    ss_counts = text(own.ss_counts).join(sites.select("site_id"), "site_id", "left_semi").select("site_id", "sample_id", "k").unionByName(theirs("k_theta", sites, "site_id"))
    samples = text(own.samples).unionByName(text(annotation), allowMissingColumns=True)
    out = own.with_(samples=samples, junctions=both, sites=sites, j_counts=j_counts, ss_counts=ss_counts)
    k = theirs("k_j", both, "junction_id").withColumnRenamed("k", "k_own")
    n5, n3 = (theirs(x, both, "junction_id").withColumnRenamed("k", x) for x in ("n_psi5", "n_psi3"))
    others = k.join(n5, ["junction_id", "sample_id"]).join(n3, ["junction_id", "sample_id"]).select("junction_id", "sample_id", (F.col("n_psi5") - F.col("k_own")).alias("o_psi5"), (F.col("n_psi3") - F.col("k_own")).alias("o_psi3"))
    n_theta = theirs("n_theta" if "n_theta" in external else "k_theta", sites, "site_id").withColumnRenamed("k", "n_theta")
    site_others = theirs("k_theta", sites, "site_id").join(n_theta, ["site_id", "sample_id"]).select("site_id", "sample_id", (F.col("n_theta") - F.col("k")).alias("o_theta"))
    return out, others, site_others


def proper_pairs(alignments: DataFrame) -> DataFrame:
    """The mates of fragments that have a first and a second mate on one sequence; others go, as do reads without a mate."""
    keys = ["sample_id", "read_id"]
    ends = alignments.groupBy(*keys).agg(F.bool_or(F.col("mate") == 1).alias("_one"), F.bool_or(F.col("mate") == 2).alias("_two"), F.min("seqname").alias("_low"), F.max("seqname").alias("_high"))
    whole = ends.filter(F.col("_one") & F.col("_two") & (F.col("_low") == F.col("_high"))).select(*keys)
    return alignments.join(whole, keys, "left_semi")
