"""Joins of genomic ranges: 1-based, both ends included, ``*`` matches every strand.

Bins are nested: each level is ``STEP`` times as wide as the one below, from ``width`` on. A range rests on the lowest level whose bins are as wide as itself, in
one bin or two, and visits the bins of the levels above on which ranges of the other table rest. So an overlap becomes an equi-join on (seqname, level, bin) with
the exact condition left over, in which one of a pair rests; a pair is kept in the bin of its larger start only, which needs no de-duplication. A
range of any length makes two rows at most for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _strands(a: str, b: str) -> Column:
    x, y = F.col(f"{a}.strand"), F.col(f"{b}.strand")
    return (x == y) | (x == "*") | (y == "*")


#: How many times as wide each level's bins are, and the number of levels.
STEP, LEVELS = 16, 8


def _resting(df: DataFrame, width: int, slop: int = 0) -> DataFrame:
    """``df`` with the level that a range rests on: the lowest one whose bins are as wide as it and the slop."""
    length = F.col("end") - F.col("start") + 1 + 2 * slop
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(length <= width * STEP**k, k).otherwise(level)
    return df.withColumn("_rest", level.cast("int"))


def _bins(df: DataFrame, level: Column, width: int, slop: int = 0) -> DataFrame:
    """A row for each bin of a level that the range and the slop meet."""
    size = F.pow(F.lit(float(STEP)), level) * width
    return df.withColumns({"_level": level, "_size": size.cast("long")}).withColumn(
        "_bin", F.explode(F.sequence(F.floor((F.col("start") - slop) / F.col("_size")).cast("long"), F.floor((F.col("end") + slop) / F.col("_size")).cast("long")))
    )


def _visiting(df: DataFrame, hosts: DataFrame, width: int, slop: int, above: int) -> DataFrame:
    """``df`` in the bins of the levels on which ranges of ``hosts`` rest, from ``above`` levels over its own on."""
    levels = hosts.agg(F.collect_set("_rest")).scalar()
    from_ = F.col("_rest") + above
    upper = F.when(from_ < LEVELS, F.sequence(from_, F.lit(LEVELS - 1)))
    seen = df.withColumn("_level", F.explode(F.array_intersect(upper, levels)))
    return _bins(seen, F.col("_level"), width, slop)


def overlap(a: DataFrame, b: DataFrame, width: int = 1000, min_overlap: int = 1, kind: str = "any", gap: int = 0) -> DataFrame:
    """Pairs as structs ``a`` and ``b``; kind: any, within, equal, start, end. ``gap`` > 0 also pairs ranges that far apart. ``width``: that of the narrowest bins."""
    if kind in ("equal", "start", "end"):
        keys = {"equal": ["start", "end"], "start": ["start"], "end": ["end"]}[kind]
        x, y = a.alias("a"), b.alias("b")
        on = F.col("a.seqname") == F.col("b.seqname")
        for k in keys:
            on &= F.col(f"a.{k}") == F.col(f"b.{k}")
        return x.join(y, on & _strands("a", "b")).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    on = (F.col("a.seqname") == F.col("b.seqname")) & (F.col("a._level") == F.col("b._level")) & (F.col("a._bin") == F.col("b._bin")) & _strands("a", "b")
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start") + 1
    on &= shared >= (min_overlap if not gap else 1 - gap)
    if kind == "within":
        on &= (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    on &= F.col("a._bin") == F.floor(F.greatest(F.col("a.start") - gap, F.col("b.start")) / F.col("a._size"))
    fields = lambda df, s: F.struct(*[F.col(f"{s}.{c}") for c in df.columns]).alias(s)
    left, right = _resting(a, width, gap), _resting(b, width)
    lower = (_visiting(left, right, width, gap, 0), _bins(right, F.col("_rest"), width))  # b rests as high as a, or higher
    higher = (_bins(left, F.col("_rest"), width, gap), _visiting(right, left, width, 0, 1))  # a rests higher
    met = [x.alias("a").join(y.alias("b"), on).select(fields(a, "a"), fields(b, "b")) for x, y in (lower, higher)]
    return met[0].union(met[1])


def overlap_narrow(a: DataFrame, b: DataFrame, width: int = 1000) -> DataFrame:
    """Pairs as structs ``a`` and ``b`` for ranges of ``b`` that are few bins of ``width`` wide: these visit the bins of all levels, so both tables are read once."""
    left = _bins(_resting(a, width), F.col("_rest"), width).alias("a")
    right = _bins(b.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))), F.col("_level"), width).alias("b")
    on = (F.col("a.seqname") == F.col("b.seqname")) & (F.col("a._level") == F.col("b._level")) & (F.col("a._bin") == F.col("b._bin")) & _strands("a", "b")
    on &= (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end"))
    on &= F.col("a._bin") == F.floor(F.greatest("a.start", "b.start") / F.col("a._size"))
    fields = lambda df, s: F.struct(*[F.col(f"{s}.{c}") for c in df.columns]).alias(s)
    return left.join(right, on).select(fields(a, "a"), fields(b, "b"))


def overlaps_any(a: DataFrame, b: DataFrame, keys: list[str], width: int = 1000, anti: bool = False) -> DataFrame:
    """The rows of ``a`` that overlap some row of ``b`` (or none)."""
    hit = overlap(a, b, width).select(*[F.col(f"a.{k}").alias(k) for k in keys]).distinct()
    return a.join(hit, keys, "left_anti" if anti else "left_semi")


def first_overlap(a: DataFrame, b: DataFrame, keys: list[str], order: list[Column], width: int = 1000) -> DataFrame:
    """For each row of ``a`` with a partner the partner that comes first; ``order`` refers to b."""
    pairs = overlap(a, b, width)
    return pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.min_by("b", F.struct(*order)).alias("b"))


def nearest(a: DataFrame, b: DataFrame, key: str, id_: str, tile: int = 1_000_000, stranded: bool = False) -> DataFrame:
    """key, the id of the nearest range of ``b`` on the same sequence (and, ``stranded``, on a strand that matches), and the gap between them (0 if they meet).

    The candidates are, in start order, the range of the furthest end among those that start at or before, and the next to
    start after: running windows over the union of both tables, no join. Sequences are cut into tiles of ``tile`` bases, so a window holds a
    tile; what comes from the tiles before and after is carried over by a window over one row for each tile.
    """
    if stranded:
        # a range stands on each strand that it matches; one without strand meets those of both
        either = F.when(F.col("strand") == "*", F.array(F.lit("+"), F.lit("-"), F.lit("*"))).otherwise(F.array(F.col("strand"), F.lit("*")))
        a = a.withColumn("seqname", F.struct("seqname", "strand"))
        b = b.withColumn("strand", F.explode(either)).withColumn("seqname", F.struct("seqname", "strand"))
    left = a.select(F.col(key).alias("key"), "seqname", "start", "end", F.lit(None).cast("string").alias("id"), F.lit(1).alias("kind"))
    right = b.select(F.lit(None).cast(a.schema[key].dataType).alias("key"), "seqname", "start", "end", F.col(id_).cast("string").alias("id"), F.lit(0).alias("kind"))
    both = left.unionByName(right).withColumn("tile", F.floor(F.col("start") / tile))
    is_b = F.col("kind") == 0
    by_end, by_start = F.when(is_b, F.struct("end", "start", "id")), F.when(is_b, F.struct("start", "end", "id"))
    row = Window.partitionBy("seqname").orderBy("tile")
    tiles = both.groupBy("seqname", "tile").agg(F.max(by_end).alias("top"), F.min(by_start).alias("low")).select(
        "seqname", "tile", F.max("top").over(row.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.first("low", ignorenulls=True).over(row.rowsBetween(1, Window.unboundedFollowing)).alias("coming")
    )
    within = Window.partitionBy("seqname", "tile").orderBy("start", "kind", "id")
    seen = both.withColumns({"prev": F.max(by_end).over(within.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first(by_start, ignorenulls=True).over(within.rowsBetween(1, Window.unboundedFollowing))})
    seen = seen.filter("kind = 1").join(tiles, ["seqname", "tile"]).withColumns({"prev": F.greatest("prev", "carried"), "next": F.coalesce("next", "coming")})
    gap_prev = F.greatest(F.lit(0), F.col("start") - F.col("prev.end") - 1)
    gap_next = F.greatest(F.lit(0), F.col("next.start") - F.col("end") - 1)
    use_prev = F.col("next").isNull() | (F.col("prev").isNotNull() & (gap_prev <= gap_next))
    return seen.select(F.col("key").alias(key), F.when(use_prev, F.col("prev.id")).otherwise(F.col("next.id")).alias("nearest"), F.when(use_prev, gap_prev).otherwise(gap_next).alias("distance"))


def introns(exons: DataFrame) -> DataFrame:
    """The gaps between the exons of a transcript: transcript_id, seqname, start, end, strand."""
    nxt = F.lead("start").over(Window.partitionBy("transcript_id").orderBy("start"))
    return exons.withColumn("_n", nxt).filter("_n > end + 1").select("transcript_id", "seqname", (F.col("end") + 1).alias("start"), (F.col("_n") - 1).alias("end"), "strand")


def windows_of(sites: DataFrame, min_anchor: int) -> DataFrame:
    """Ranges widened by min_anchor - 1 on both sides."""
    return sites.withColumns({"start": F.col("start") - (min_anchor - 1), "end": F.col("end") + (min_anchor - 1)})


def nonsplit_counts(reads: DataFrame, sites: DataFrame, min_anchor: int = 5, width: int = 200) -> DataFrame:
    """site_id, sample_id, k: distinct fragments that cover at least 2 min_anchor bases of the window around a site."""
    pairs = overlap(reads, windows_of(sites, min_anchor + 1), width, 2 * min_anchor)
    return pairs.groupBy(F.col("b.site_id").alias("site_id"), F.col("a.sample_id").alias("sample_id")).agg(F.count_distinct("a.fragment").alias("k"))


def coverage(ranges: DataFrame, keys: list[str], tile: int = 1_000_000) -> DataFrame:
    """Stretches of constant depth: keys, seqname, start, end, depth, by a sweep over the ends of ranges.

    A sequence is swept in tiles of ``tile`` bases; each starts from the depth that the tiles before leave, a window over one row for each tile.
    """
    ends = ranges.select(*keys, "seqname", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, "seqname", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).withColumn("tile", F.floor(F.col("at") / tile))
    on = [*keys, "seqname", "tile"]
    row = Window.partitionBy(*keys, "seqname").orderBy("tile")
    tiles = steps.groupBy(*on).agg(F.sum("d").alias("total"), F.min("at").alias("first")).select(
        *on, F.coalesce(F.sum("total").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(row).alias("after")
    )
    by = Window.partitionBy(*on).orderBy("at")
    swept = steps.withColumns({"run": F.sum("d").over(by), "next": F.lead("at").over(by)}).join(tiles, on)
    out = swept.withColumns({"depth": F.col("before") + F.col("run"), "end": F.coalesce("next", "after") - 1})
    return out.filter("depth > 0").select(*keys, "seqname", F.col("at").alias("start"), "end", "depth")
