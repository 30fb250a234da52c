"""Genome sequences: FASTA files of any size as overlapping chunks, and what stands at given places of them.

Files are read as splittable text. Where a line stands in its sequence follows from sums within its split and from one row for each sequence and split that carries
them over; lines are cut at chunk borders and put together by chunk. So neither a sequence nor a file has to be in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bases of a chunk, and of the next chunk that it repeats.
CHUNK, OVERLAP = 1 << 16, 64
#: The first and last two bases of introns that splicing removes; the other strand has their reverse complements.
MOTIFS = ("GT-AG", "GC-AG", "AT-AC", "AT-AA", "AT-AG")


def read_fasta(spark: SparkSession, path: str | list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """seqname, chunk and bases: upper-case bases from ``chunk`` * chunk on (0-based), with ``overlap`` bases of the next chunk.

    A sequence is named by the first word behind ``>``. Lines of any length, wrapped or not, empty ones and comments (``;``) are allowed; what stands before the first name is left out.
    """
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    lines = lines.filter("line <> '' and not startswith(line, ';')").withColumn("head", F.col("line").startswith(">"))
    row = Window.partitionBy("file", "split").orderBy("id")
    lines = lines.withColumns({"nth": F.sum(F.col("head").cast("int")).over(row), "size": F.when(F.col("head"), 0).otherwise(F.length("line")).cast("long")})
    part = Window.partitionBy("file", "split", "nth").orderBy("id")
    lines = lines.withColumn("within", F.sum("size").over(part) - F.col("size"))
    # a row for each piece of a sequence in a split; the first piece of a split goes on with the last one of the split before
    pieces = lines.groupBy("file", "split", "nth").agg(F.sum("size").alias("total"), F.max(F.when(F.col("head"), F.regexp_extract("line", r"^>\s*(\S*)", 1))).alias("name"))
    along = Window.partitionBy("file").orderBy("split", "nth")
    pieces = pieces.withColumn("number", F.count("name").over(along))
    before = Window.partitionBy("file", "number").orderBy("split", "nth").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file", "number")
    pieces = pieces.filter("number > 0").select("file", "split", "nth", F.max("name").over(whole).alias("seqname"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    placed = lines.filter(~F.col("head")).join(pieces, ["file", "split", "nth"]).select("seqname", (F.col("carried") + F.col("within")).alias("at"), F.upper("line").alias("line"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - overlap) / chunk))
    last = F.floor((F.col("at") + F.length("line") - 1) / chunk)
    cut = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("chunk") * chunk)
    high = F.least(F.col("at") + F.length("line"), (F.col("chunk") + 1) * chunk + overlap)
    cut = cut.withColumns({"low": low, "high": high}).filter("high > low").select("seqname", "chunk", "low", F.col("line").substr((F.col("low") - F.col("at") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("part"))
    joined = cut.groupBy("seqname", "chunk").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("parts"))
    return joined.select("seqname", "chunk", F.array_join("parts.part", "").alias("bases"))


def with_bases(df: DataFrame, chunks: DataFrame, at: Column, length: int, name: str = "bases", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` (seqname) with the ``length`` bases from the 1-based place ``at`` on, NULL where the sequence does not have all of them."""
    if length > overlap + 1:
        raise ValueError("the chunks overlap by too few bases")
    own = df.withColumns({"_at": at.cast("long") - 1, "_chunk": F.floor((at.cast("long") - 1) / chunk)})
    right = chunks.select(F.col("seqname").alias("_seqname"), F.col("chunk").alias("_number"), F.col("bases").alias("_bases"))
    met = own.join(right, (F.col("seqname") == F.col("_seqname")) & (F.col("_chunk") == F.col("_number")), "left")
    found = F.col("_bases").substr((F.col("_at") - F.col("_chunk") * chunk + 1).cast("int"), F.lit(length))
    return met.withColumn(name, F.when((F.col("_at") >= 0) & (F.length(found) == length), found)).drop("_at", "_chunk", "_seqname", "_number", "_bases")


def complement(bases: str) -> str:
    """The other strand's bases, from its own first to its last."""
    return bases[::-1].translate(str.maketrans("ACGT", "TGCA"))


def motif_table() -> dict[str, str]:
    """The strand of every motif as it stands on the forward strand."""
    out = dict.fromkeys(MOTIFS, "+")
    for m in MOTIFS:
        left, right = m.split("-")
        out[f"{complement(right)}-{complement(left)}"] = "-"
    return out


def intron_motifs(junctions: DataFrame, chunks: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """seqname, start, end, motif (the first and the last two bases of the intron) and strand: that of the motif, ``*`` where it is not a known one."""
    out = junctions.select("seqname", "start", "end").distinct()
    out = with_bases(out, chunks, F.col("start"), 2, "_left", chunk, overlap)
    out = with_bases(out, chunks, F.col("end") - 1, 2, "_right", chunk, overlap).withColumn("motif", F.concat("_left", F.lit("-"), "_right"))
    known = F.create_map(*[F.lit(x) for pair in motif_table().items() for x in pair])
    return out.withColumn("strand", F.coalesce(F.element_at(known, F.coalesce("motif", F.lit(""))), F.lit("*"))).drop("_left", "_right")
