"""Exact Jaccard join of word n-gram sets by PartEnum signatures.

Sets of equal content are folded to the one of the smallest doc_id first. The sizes are cut into
bands so that similar sets lie in the same band or in neighbouring ones; for each band that a set
may meet a partner in, the feature domain is dealt into m > k partitions, k being the largest
symmetric difference that two similar sets of that band can have. Then at least m - k partitions agree
in full, so similar sets share one of the signatures hash(band, partition, features in it). (The
enumerated subsets are the single partitions: second-level threshold 0.) Empty partitions do not sign, or a signature
would be common to many sets without a reason; m is chosen so that a set has fewer than m - k of them as a rule, and then
a partition that agrees and is not empty is left. A set with more is also dealt by a second and, if need be, a third
function, and in that one's last place empty partitions sign, too, so agreement is never missed.

Candidates are pruned exactly: a set whose shingles that no other candidate has outnumber what a partner
may lack can have no partner. The rest is compared with the smallest doc_id of each signature group
(a star, linear in the group), which also yields what each set has inside and outside that leader.
Where links leave a group in more than one component, a pair across components is compared only
if its common part can be large enough: at most the smaller part inside the leader and, if the two share anything
outside it, the smaller public part there. Comparison is the exact intersection of sets of 64-bit
shingle hashes. The operator gives components only: other links inside of a component are neither verified nor counted.

Defined cases: null or wordless text has an empty set and links with nothing; rows that repeat a
doc_id count as one document if their texts agree; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .graph import components

LEVELS = 3
#: Ids of candidates are broadcast up to this number, beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Signatures that a task holds and sorts at a time, and bytes of text that it signs at a time.
HELD_SIGNATURES, SLICE = 500_000, 1 << 18
#: Shingles of the corpus for each bucket of signatures.
BUCKET_SHINGLES = 500_000


def bands(top: int, num: int, den: int) -> np.ndarray:
    """Upper size of each band: a set of at most bands[i] has partners of at most bands[i + 1]."""
    out = [0]
    while out[-1] < top:
        out.append((out[-1] + 1) * den // num)
    return np.array(out[1:], np.int64)


def _signatures(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature for all rows; rows are those of the sorted, distinct ``hashes``."""
    uppers = bands(int(sizes.max(initial=1)) * den // num + 2, num, den)
    band = np.searchsorted(uppers, sizes, "left")
    out_rows, out_sigs = [], []
    for step in (0, 1):
        tag = np.minimum(band + step, len(uppers) - 1)
        # |A ^ B| <= (|A| + |B|) (den - num) / (den + num)
        differ = 2 * uppers * (den - num) // (den + num)
        spare = differ + 1
        for _ in range(4):  # room for twice the partitions that are empty by chance in the smallest sets of the band
            spare = differ + 1 + np.ceil(2 * spare * np.exp(-(uppers * num / den) * num / den / spare)).astype(np.int64)
        parts, differ = spare[tag], differ[tag]
        tag = band + step
        todo = sizes > 0
        for level in range(LEVELS):
            if not todo.any():
                break
            use = todo[rows]
            r, h = rows[use], tx.mix(hashes[use] + np.uint64(level * 0x51ED2701 + 1))
            n = np.where(todo, parts, 0)
            base = np.concatenate([[0], np.cumsum(n)])
            slot = base[r] + (h % n[r].astype(np.uint64)).astype(np.int64)
            total, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
            np.add.at(total, slot, tx.mix(h ^ np.uint64(0x2545F4914F6CDD1D)))
            filled[slot] = True
            owner = np.repeat(np.arange(len(n)), n)
            index = np.arange(base[-1]) - base[owner]
            sign = tx.mix(total + tx.mix((tag[owner] * (1 << 34) + index * LEVELS + level).astype(np.uint64)))
            keep = filled if level < LEVELS - 1 else np.ones(len(filled), bool)
            out_rows.append(owner[keep])
            out_sigs.append(sign[keep])
            empty = np.bincount(owner[~filled], minlength=len(n))
            todo = todo & (empty >= parts - differ)
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out_sigs)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(rows, kind="stable")
    ends = np.searchsorted(rows[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order].view(np.int64)))


def _set_key(rows: np.ndarray, hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, rows, tx.mix(hashes + np.uint64(seed)))
    return tx.mix(out)


def _profiled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                n = end - first
                rows, hashes = tx.distinct_shingles(data, bounds, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.bincount(rows, minlength=n), pa.int64()), pa.array(_set_key(rows, hashes, n, 11).view(np.int64)), pa.array(_set_key(rows, hashes, n, 17).view(np.int64))],
                    names=["doc_id", "n_shingles", "key1", "key2"],
                )

    return run


def _dealt(width: int, num: int, den: int, buckets: int):
    """Signatures in packed rows by bucket, ``HELD_SIGNATURES`` at a time. A signature of two documents among these goes out once as a mark; its documents are dealt by their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, held = [], [], 0
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text"), SLICE):
                rows, hashes = tx.distinct_shingles(data, bounds, width)
                r, g = _signatures(rows, hashes, np.bincount(rows, minlength=end - first), num, den)
                sigs.append(g)
                docs.append(batch.column("doc_id").slice(first, end - first).to_numpy(zero_copy_only=False)[r])
                held += len(g)
                if held >= HELD_SIGNATURES:
                    yield from _packed(np.concatenate(sigs), np.concatenate(docs), buckets)
                    sigs, docs, held = [], [], 0
        if held:
            yield from _packed(np.concatenate(sigs), np.concatenate(docs), buckets)

    return run


def _packed(sig: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))[: len(sig)]
    sig, doc = sig[new], doc[new]
    head = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
    several = np.bincount(np.cumsum(head) - 1, minlength=1)[np.cumsum(head) - 1] > 1
    for kind, pick in ((0, ~several), (1, several & head), (2, several)):
        g, d = sig[pick], doc[pick]
        b = (d.view(np.uint64) if kind == 2 else g) % np.uint64(buckets)
        order = np.argsort(b, kind="stable")
        b, g, d = b[order], g[order], d[order]
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
        ends = np.append(at[1:], len(b))[: len(at)]
        small = len(d) > 0 and 0 <= d.min() and d.max() < 2**32
        d = d.astype("<u4" if small else "<i8")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(b[at].astype(np.int64)), pa.array(np.full(len(at), kind), pa.int32()), pa.array(np.full(len(at), small), pa.bool_()),
                pa.array([_five(g[x:y] // np.uint64(buckets)) for x, y in zip(at, ends, strict=True)] if kind < 2 else [_five(g[x:y] // np.uint64(buckets)) + (g[x:y] % np.uint64(buckets)).astype("<u4").tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()), pa.array([b"" if kind == 1 else d[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()),
            ],
            names=["bucket", "kind", "small", "sigs", "docs"],
        )


def _five(values: np.ndarray) -> bytes:
    """Five bytes of each number: signatures that fall together by that only add candidates."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _meeting(table: pa.Table) -> pa.Table:
    """sig and doc_id of the signatures that more than one document has; sig is the bucket and five bytes."""
    own = np.uint64(table.column("bucket")[0].as_py()) if len(table) else np.uint64(0)
    sig, doc, kind = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for r in table.to_pylist():
        raw, n = r["sigs"], len(r["sigs"]) // (9 if r["kind"] == 2 else 5)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw[: 5 * n], np.uint8).reshape(-1, 5)
        bucket = np.frombuffer(raw[5 * n :], "<u4").astype(np.uint64) if r["kind"] == 2 else own
        g = wide.view("<u8").ravel() | bucket << np.uint64(40)
        sig.append(g)
        doc.append(np.zeros(len(g), np.int64) if r["kind"] == 1 else np.frombuffer(r["docs"], "<u4" if r["small"] else "<i8").astype(np.int64))
        kind.append(np.full(len(g), r["kind"], np.int32))
    sig, doc, kind = np.concatenate(sig), np.concatenate(doc), np.concatenate(kind)
    order = np.argsort(sig, kind="stable")
    order = order[kind[order] < 2]
    s = sig[order]
    head = np.append(True, s[1:] != s[:-1])[: len(s)]
    n = np.bincount(np.cumsum(head) - 1, minlength=1)[np.cumsum(head) - 1] if len(s) else np.zeros(0, int)
    keep = np.concatenate([order[(n > 1) & (kind[order] == 0)], np.flatnonzero(kind == 2)])
    return pa.table({"sig": pa.array(sig[keep].view(np.int64)), "doc_id": pa.array(doc[keep])})


def _shingle_lists(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), _lists(*tx.distinct_shingles(data, bounds, width), end - first)], names=["doc_id", "shingles"])

    return run


def _compared(num: int, den: int):
    """Adds the size of the intersection, what a has outside b, and whether the sets are similar; lists are sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, outside, similar = [], [], []
            a, b = batch.column("a_set"), batch.column("b_set")
            ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
            av, bv = a.values.to_numpy(), b.values.to_numpy()
            for i in range(len(batch)):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                out = x[~np.isin(x, y, assume_unique=True, kind="sort")]
                n = len(x) - len(out)
                common.append(n)
                outside.append(out)
                similar.append(n > 0 and den * n >= num * (len(x) + len(y) - n))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, outside)]).astype(np.int32), pa.array(np.concatenate([*outside, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), lists, pa.array(similar, pa.bool_())], names=["a", "b", "common", "outside", "similar"])

    return run


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (documents of the same set)."""
    with tx.scratch():
        return tx.written(_components(docs, width, num, den), "components", keep=True)


def _components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = tx.written(docs.mapInArrow(_profiled(width), "doc_id long, n_shingles long, key1 long, key2 long"), "signed")
    one = signed.filter("n_shingles > 0")
    classes = one.groupBy("n_shingles", "key1", "key2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    # a set that one document has needs no join; those of several are few where they fit a broadcast, so a hot set is not dealt to one task
    copied = tx.written(classes.filter("n_copies > 1"), "copied-sets")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_IDS else copied
    joined = one.join(copied, ["n_shingles", "key1", "key2"], "left")
    member = tx.written(joined.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")), "members")
    copies = member.filter("doc_id <> rep").select("doc_id").distinct()
    originals = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    shingles = one.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(24, int(shingles) // BUCKET_SHINGLES)
    dealt = originals.mapInArrow(_dealt(width, num, den, buckets), "bucket long, kind int, small boolean, sigs binary, docs binary")
    shared = tx.written(dealt.groupBy("bucket").applyInArrow(_meeting, "sig long, doc_id long"), "shared")

    candidates = tx.written(shared.select("doc_id").distinct(), "candidates")
    n = candidates.count()
    ids = F.broadcast(candidates) if n <= BROADCAST_IDS else candidates
    sets = tx.written(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_shingle_lists(width), "doc_id long, shingles array<long>"), "sets")
    # a shingle of one candidate only is private to it
    private = sets.select("doc_id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("private"))
    size = F.size("shingles").cast("long")
    # a partner has num/den of the set at least, all of it outside the private part
    able = tx.written(
        sets.join(private, "doc_id", "left").select("doc_id", size.alias("n"), (size - F.coalesce("private", F.lit(0))).alias("public"), "shingles").filter(F.col("public") * den >= num * F.col("n")),
        "able",
    )
    facts = able.select("doc_id", "n", "public")
    live = tx.written(shared.distinct().join(facts, "doc_id"), "live")

    def compared(pairs: DataFrame) -> DataFrame:
        a = able.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set"))
        b = able.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set").mapInArrow(_compared(num, den), "a long, b long, common long, outside array<long>, similar boolean")

    head = live.groupBy("sig").agg(F.min("doc_id").alias("head"))
    led = live.join(head, "sig")
    star = tx.written(compared(led.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()), "star")
    first = star.filter("similar").select("a", "b")
    label = tx.written(components(first), "labels")

    # groups whose members do not all lie in one component yet
    named = tx.written(led.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "named")
    mixed = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("sig")
    rest = named.filter("doc_id <> head").join(mixed, "sig").join(star.select(F.col("a").alias("doc_id"), F.col("b").alias("head"), "common", "outside"), ["doc_id", "head"]).withColumn("beyond", F.col("public") - F.col("common"))
    x, y = rest.alias("x"), rest.alias("y")
    need, inside = num * (F.col("x.n") + F.col("y.n")), F.least("x.common", "y.common")
    may_link = (inside * (num + den) >= need) | (((inside + F.least("x.beyond", "y.beyond")) * (num + den) >= need) & F.arrays_overlap("x.outside", "y.outside"))
    across = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") < F.col("y.component")) & may_link)
    second = compared(across.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()).filter("similar").select("a", "b")
    links = tx.written(first.unionByName(second), "links")
    final = components(links)
    classed = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "n_copies")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return classed.unionByName(empty)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(tx.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(c) FROM r WHERE r.doc_id = s.doc_id), doc_id)) AS component_id FROM s
"""
