"""Removal of lines that are similar to an earlier line: an exact set-similarity join in DataFrame operations.

A line is the set of its lower-cased words. Of two lines with Jaccard similarity of at least NUM/DEN the
later one, by (doc_id, place), goes; lines are judged on the input. Lines of fewer than ``min_words`` distinct words
stay; by default every line that has a word is judged.

Words are 57-bit hashes with the rarity of the word in the bits above, so the natural order of the numbers
is an order by rarity. Rarity is the logarithm of the word's count over all documents, in a table of ``2 ** BITS`` hashed counters,
whose size does not depend on the corpus. Lines with equal sets (by a 64-bit hash, the size and the first half of the parity map) fold into one class. Two similar sets share one of the
``n - ceil(n NUM / DEN) + 1`` rarest words of each (prefix filter); on that word the classes meet, and a
pair goes on only if the sizes (length filter), the places of the word (positional filter) and a
parity map, whose differing bits bound the symmetric difference, allow the
similarity. The map has 64 bits for the words up to the rarity that halves the corpus, and 64 for the others. Sets so small that only equal ones are similar (up to 3 words at 4/5) are settled by their class and
have no prefix. First each class meets, on each of its ``LEADING`` rarest words, the earliest class and the ``BEFORE`` classes just before it only,
which is linear in a word's group and settles nearly all members of a group of similar lines; only classes that this does not settle meet the others, by a join whose hot words Spark can split. The pairs left are verified
on the words of the lines themselves.

Defined cases: a null text has no lines and stays null; an empty text has one empty line; lines of rows without a doc_id stay and
settle nothing; rows of one doc_id and one text are read as one document, those of one doc_id and different texts as different documents, in the order of a hash of
the text; repeated lines within a document count as later copies; extra columns are carried, but ones named n_lines and n_removed give way to the results; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import ranks
from . import text as tx

NUM, DEN = 4, 5
MIN_WORDS = 1
BITS = 18
#: Words of a prefix by which a class meets the earliest class and as many before it; what this does not settle meets all by all words.
LEADING, BEFORE = 6, 3
#: Rows of two or three numbers are broadcast up to this count, beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: From as many partitions on a file for each is too many.
MANY_FILES = 64
#: ``place`` has the number of a line in its lower half, and above it the number of the text among the different texts of its doc_id.
LINE = ["doc_id", "place"]


def _plain_blanks(text: str) -> Column:
    """The text with other white space of a line as blanks; most texts have none and are not copied."""
    odd = ["\t", "\r", "\x0b", "\x0c"]
    has = F.contains(text, F.lit(odd[0]))
    for c in odd[1:]:
        has |= F.contains(text, F.lit(c))
    return F.when(has, F.translate(text, "".join(odd), "    ")).otherwise(F.col(text))


def _copies(docs: DataFrame) -> DataFrame | None:
    """(doc_id, hash, copy): for each doc_id of several texts the number of each of them, from 0; None where there is no such doc_id."""
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = tx.written(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    texts = tx.written(own.join(_small(again), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("hash")).distinct(), "repeated-texts")
    if texts.isEmpty():
        return None
    numbers = tx.written(ranks.numbered(texts, ["doc_id", "hash"]), "numbered-texts")
    first = numbers.groupBy("doc_id").agg(F.min("number").alias("first"))
    return tx.written(numbers.join(first, "doc_id").select("doc_id", "hash", (F.col("number") - F.col("first")).alias("copy")), "copies", keep=True)


def _with_copy(docs: DataFrame, copies: DataFrame | None, name: str) -> DataFrame:
    if copies is None:
        return docs.withColumn(name, F.lit(0).cast("long"))
    own = copies.select(F.col("doc_id").alias(f"{name}_id"), F.col("hash").alias(f"{name}_hash"), F.col("copy").alias(name))
    met = docs.join(_small(own), (F.col("doc_id").cast("long") == F.col(f"{name}_id")) & (F.xxhash64("text") == F.col(f"{name}_hash")), "left")
    return met.withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).drop(f"{name}_id", f"{name}_hash")


def _lines(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", "copy", F.posexplode(F.split(F.lower(_plain_blanks("text")), "\n")).alias("place", "line"))
    return found.select("doc_id", (F.shiftleft("copy", 32) + F.col("place")).alias("place"), "line")


def _slot(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITS).cast("int")


def _words(line: str) -> Column:
    """The hashes of the distinct words of a line."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))


def _levels(words: DataFrame) -> tuple[Column, int]:
    """What turns the seven upper bits of a word's hash into its rarity level, for each counter, as one literal array of 2 ** BITS numbers; and the level that halves the words."""
    hashes = words.select(F.explode("words").alias("w"))
    # a row for 2 ** 2 counters, so that the partial counts of a task stay in Spark's small hash map
    slots = hashes.select(_slot(F.col("w")).alias("slot")).select(F.shiftright("slot", 2).alias("row"), F.col("slot").bitwiseAND(F.lit(3)).alias("at"))
    counts = slots.groupBy("row").agg(*[F.count_if(F.col("at") == k).alias(f"n{k}") for k in range(4)])
    # 2 ** BITS levels at most, packed into a few strings by the JVM
    row = F.concat_ws(":", "row", *[F.when(F.col(f"n{k}") > 0, F.least(F.lit(120), 1 + F.floor(4 * F.log2(f"n{k}")))).otherwise(0).cast("int") for k in range(4)])
    packed = counts.groupBy((F.col("row") / 1024).cast("int").alias("part")).agg(F.array_join(F.collect_list(row), ",").alias("levels"))
    found = [0] * (1 << BITS)
    for r in packed.collect():
        for part in r.levels.split(","):
            at, *levels = map(int, part.split(":"))
            found[4 * at : 4 * at + 4] = levels
    # the counts that the levels stand for
    weights = [0.0] * 128
    for at in found:
        weights[at] += 2 ** ((at - 1) / 4) if at else 0
    middle, below = 0, 0.0
    while middle < 120 and below + weights[middle] <= sum(weights) / 2:
        below += weights[middle]
        middle += 1
    # the upper bit is the sign: levels from 64 on are positive numbers
    turns = ",".join(str(at ^ 64 ^ (slot >> (BITS - 7))) for slot, at in enumerate(found))
    return F.split(F.lit(turns), ",").cast("array<bigint>"), (middle - 64) << 57


def _marked_keys(words: str, levels: Column, mark: int) -> Column:
    """The distinct words of a line, given as hashes, as numbers, the rarest first, and among them ``mark``."""

    def key(h: Column) -> Column:
        turn = F.coalesce(F.get(levels, F.shiftrightunsigned(h, 64 - BITS)), F.lit(0).cast("long"))
        return h.bitwiseXOR(F.shiftleft(turn, 57))

    return F.sort_array(F.concat(F.transform(words, key), F.array(F.lit(mark).cast("long"))))


def _parity(keys: str) -> Column:
    """A map of 64 bits, each turned by every key that falls on it."""
    one = F.lit(1).cast("long")
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def similar_lines(docs: DataFrame, num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, copy, place) of the lines that go; copy is 0 but for a doc_id of several texts."""
    with tx.scratch():
        return _numbered(_similar_lines(docs, _copies(docs), num, den, min_words))


def _numbered(gone: DataFrame) -> DataFrame:
    parted = gone.select("doc_id", F.shiftright("place", 32).alias("copy"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    return tx.written(parted, "similar-lines", keep=True)


def _facts(words: DataFrame, num: int, den: int) -> DataFrame:
    """For each line its set, size, parity maps and prefix."""
    levels, mark = _levels(words)
    marked = words.select(*LINE, _marked_keys("words", levels, mark).alias("keys"))
    halves = marked.withColumns({"n": F.size("keys") - 1, "cut": F.array_position("keys", F.lit(mark).cast("long")).cast("int")})
    halves = halves.withColumns({"rare": F.slice("keys", 1, F.col("cut") - 1), "common": F.slice("keys", F.col("cut") + 1, F.size("keys"))})
    n = F.col("n")
    # a set of n words can be similar to one of n + 1 only if den n >= num (n + 1); smaller ones match equal sets alone
    small = n * (den - num) < num
    wanted = F.slice(F.concat("rare", "common"), 1, n - F.ceil(n * num / F.lit(float(den)) - 1e-9).cast("int") + 1)
    prefix = F.when(small, F.array().cast("array<bigint>")).otherwise(wanted)
    # in a prefix a word is known by 31 bits: words that fall together only add candidates
    short = F.transform(prefix, lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    return tx.written(halves.select(*LINE, F.xxhash64("keys").alias("set"), "n", _parity("rare").alias("parity"), _parity("common").alias("half"), short.alias("prefix")), "lines")


def _dealt(classes: DataFrame, num: int, den: int, *more: str) -> DataFrame:
    """A row for each word of a prefix, with ``most``: the words of the largest set that a class of n words can be similar to if this word, its i-th, is the first in both.

    Two sets share min(nx - ix, ny - iy) words at most there and need (nx + ny) num / (num + den). Taken apart, that is a number for
    each side, and it holds the length filter, too. No column can be null, so a join does not ask for each pair.
    """
    rows = classes.select(*LINE, "n", "parity", "half", *more, F.posexplode("prefix").alias("i", "word"))
    most = F.floor(((num + den) * (F.col("n").cast("long") - F.col("i")) - num * F.col("n").cast("long")) / F.lit(float(num)) + 1e-9).cast("long")
    sure = [F.coalesce(c, F.lit(0)).alias(c) for c in (*LINE, "n", "parity", "half", *more, "word")]
    return rows.select(*sure, "i", F.coalesce(most, F.lit(0)).alias("most"))


def _similar_lines(docs: DataFrame, copies: DataFrame | None, num: int, den: int, min_words: int) -> DataFrame:
    docs = _with_copy(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null and doc_id is not null"), copies, "copy")
    # words are hashed once, for the counters and for the keys: Spark keeps the hashes on its disks in between
    hashed = _lines(docs).select(*LINE, _words("line").alias("words")).persist(StorageLevel.DISK_ONLY)
    try:
        facts = _facts(hashed, num, den)
    finally:
        hashed.unpersist(blocking=True)
    # not before the table is written, or the words of a line would be ordered twice
    facts = facts.filter(F.col("n") >= max(min_words, 1))
    same = ["set", "n", "parity"]
    folded = facts.groupBy(*same).agg(F.min(F.struct(*LINE)).alias("head"), F.count(F.lit(1)).alias("members"), F.any_value("half").alias("half"), F.any_value("prefix").alias("prefix"))
    classes = tx.written(folded.select("head.*", *same, "half", "members", "prefix"), "classes")
    rows = _dealt(classes, num, den)

    def may_match(x: str, y: str) -> Column:
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        # the bits that differ in the rarer half of the keys and those in the other
        differ = F.bit_count(F.col(f"{x}parity").bitwiseXOR(F.col(f"{y}parity"))) + F.bit_count(F.col(f"{x}half").bitwiseXOR(F.col(f"{y}half")))
        # symmetric difference <= (nx + ny) (den - num) / (den + num)
        return (ny <= F.col(f"{x}most")) & (nx <= F.col(f"{y}most")) & (differ * (num + den) <= (den - num) * (nx + ny))

    other = ["o_doc_id", "o_place"]
    near = Window.partitionBy("word").orderBy(*LINE)
    own = F.struct(*LINE, "n", "parity", "half", "most")
    few = F.array(F.first(own).over(near), *[F.lag(own, k).over(near) for k in range(1, BEFORE + 1)])
    led = rows.filter(F.col("i") < LEADING).withColumn("few", few).withColumn("lead", F.explode("few")).drop("few").filter("lead is not null and (doc_id <> lead.doc_id or place <> lead.place)").filter(may_match("", "lead."))
    first = tx.written(led.select(*LINE, F.col("lead.doc_id").alias("o_doc_id"), F.col("lead.place").alias("o_place"), (F.col("n") + F.col("lead.n")).alias("total")).distinct(), "line-pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        """The lines of ``pairs`` that are similar to their other line; ``total`` is the sum of the sizes of both."""
        wanted = tx.written(pairs.select(F.explode(F.array(F.struct(*LINE), F.struct(F.col("o_doc_id").alias("doc_id"), F.col("o_place").alias("place")))).alias("x")).select("x.*").distinct(), "wanted")
        ids = tx.written(wanted.select("doc_id").distinct(), "wanted-documents")
        again = _lines(docs.join(_small(ids), "doc_id", "left_semi")).join(_small(wanted), LINE, "left_semi")
        texts = tx.written(again.select(*LINE, "line"), "line-texts")
        a, b = texts.withColumnRenamed("line", "a"), texts.withColumnsRenamed({"doc_id": "o_doc_id", "place": "o_place", "line": "b"})
        # an intersection has each word once; two blanks in a row make an empty one
        both = F.size(F.array_intersect(F.array_remove(F.split("a", " "), ""), F.split("b", " ")))
        return pairs.join(a, LINE).join(b, other).filter(both * (num + den) >= num * F.col("total")).select(*LINE).distinct()

    settled = tx.written(verified(first), "settled")
    marked = classes.join(_small(settled.withColumn("done", F.lit(1))), LINE, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    rest = _dealt(marked, num, den, "done").drop("i")
    x, y = rest.alias("x"), rest.alias("y")
    earlier = (F.col("y.doc_id") < F.col("x.doc_id")) | ((F.col("y.doc_id") == F.col("x.doc_id")) & (F.col("y.place") < F.col("x.place")))
    # written over both sides, so that these keep one plan and share one exchange
    not_settled = F.col("x.done") * (F.col("y.done") + 1) == 0
    # nearly all pairs that a word brings together end at the first conditions
    meet = x.join(y, (F.col("x.word") == F.col("y.word")) & may_match("x.", "y.") & earlier & not_settled)
    second = meet.select(F.col("x.doc_id").alias("doc_id"), F.col("x.place").alias("place"), F.col("y.doc_id").alias("o_doc_id"), F.col("y.place").alias("o_place"), (F.col("x.n") + F.col("y.n")).alias("total")).distinct()
    second = tx.written(second.join(first, [*LINE, *other], "left_anti"), "line-pairs")
    gone = settled.unionByName(verified(second)).distinct().withColumn("gone", F.lit(True))
    # every later member of a class goes, and the first one, too, if the class is similar to an earlier one
    touched = classes.join(_small(tx.written(gone, "gone")), LINE, "left").filter((F.col("members") > 1) | F.col("gone"))
    touched = touched.select(*same, F.col("doc_id").alias("h_doc_id"), F.col("place").alias("h_place"), F.coalesce("gone", F.lit(False)).alias("gone"))
    later = F.col("gone") | (F.col("doc_id") != F.col("h_doc_id")) | (F.col("place") != F.col("h_place"))
    return facts.select(*LINE, *same).join(touched, same).filter(later).select(*LINE)


def _removed_places(docs: DataFrame, num: int, den: int, min_words: int) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, copy and the distinct places of its lines that go, which are bounded by the document itself; and the copies."""
    with tx.scratch():
        copies = _copies(docs)
        gone = _numbered(_similar_lines(docs, copies, num, den, min_words))
    return gone.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("place")).alias("places")), copies


def dedup_lines(docs: DataFrame, num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines taken out of ``text``, and columns n_lines and n_removed."""
    own, copy, places = (tx.fresh(name, docs.columns) for name in ("id", "copy", "places"))
    drop, copies = _removed_places(docs, num, den, min_words)
    drop = drop.select(F.col("doc_id").alias(own), F.col("copy").alias(f"{copy}_of"), F.col("places").alias(places))
    joined = _with_copy(docs, copies, copy).join(drop, (F.col("doc_id").cast("long") == F.col(own)) & (F.col(copy) == F.col(f"{copy}_of")), "left").drop(own, copy, f"{copy}_of")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(places, i)), "\n")
    return joined.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(places), F.lit(0)).cast("long"), "text": F.when(F.col(places).isNotNull(), kept).otherwise(F.col("text"))}).drop(places)


@contextlib.contextmanager
def one_file_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffles have enough partitions that a task writes one file for all of them.

    Up to 200 partitions, which is also the usual number, a task without sums opens a file for each; over many tasks these cost more than the rows.
    Sessions that have set a few partitions keep them.
    """
    name, most = "spark.sql.shuffle.partitions", int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    old = spark.conf.get(name)
    if MANY_FILES <= int(old) <= most:
        spark.conf.set(name, str(most + 1))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = tx.table(spark, sf_dir, "documents").select("doc_id", "text")
    with one_file_shuffles(spark):
        drop, copies = _removed_places(docs, NUM, DEN, MIN_WORDS)
        squares = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + (p + 1).cast("long") * (p + 1))
        lines = _with_copy(docs, copies, "copy").select(F.col("doc_id").cast("long").alias("doc_id"), "copy", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
        counts = lines.join(drop, ["doc_id", "copy"], "left").select("doc_id", "n_lines", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(squares, F.lit(0)).cast("long").alias("place_squares"))
        return tx.written(counts, "line-counts", keep=True)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS place, unnest(ls) AS line FROM d WHERE ls IS NOT NULL),
k AS (SELECT doc_id, place, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min((doc_id, place)) AS head, row_number() OVER () AS c FROM k WHERE len(ws) >= 1 GROUP BY ws),
f AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM c) GROUP BY w),
o AS (SELECT c, n, head, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS i FROM (SELECT c, n, head, unnest(ws) AS w FROM c) JOIN f USING (w)),
p AS (SELECT * FROM o WHERE i <= n - ceil(n * 4 / 5.0)::INT + 1),
pairs AS (SELECT DISTINCT x.c AS x, y.c AS y FROM p x JOIN p y ON x.w = y.w AND y.head < x.head AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
gone AS (SELECT DISTINCT x.c FROM pairs JOIN c x ON x.c = pairs.x JOIN c y ON y.c = pairs.y WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n)),
r AS (SELECT DISTINCT k.doc_id, k.place FROM k JOIN c ON k.ws = c.ws WHERE (k.doc_id, k.place) > c.head OR c.c IN (SELECT c FROM gone)),
a AS (SELECT doc_id, count(*) AS n_removed, sum((place + 1) * (place + 1)) AS q FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(q, 0)::BIGINT AS place_squares FROM d LEFT JOIN a USING (doc_id)
"""
