"""Containment search for short benchmark items in long documents, by size-partitioned MinHash sketches.

An item is the set of its ``width``-word shingles (items of fewer words: one shingle of all their words).
Items are partitioned by size, by powers of two. A partition of upper size u gets the sketch depth
``floor((1 - t) u) + 1``: the sketch of an item is that many of its smallest MinHash values. A document
that contains the share t of an item lacks at most floor((1 - t) u) of its shingles, so it has one
of the sketch at least: the search misses nothing, however long the document, and the document needs
no sketch of its own. A document with a sketch value of an item is verified by exact shingle containment.

Sketches are a table. Up to ``block`` shingles of items, which are counted first, tasks get it by a broadcast and one pass over the documents
finds and verifies. Beyond that nothing passes through the driver: documents meet the sketches by a join on the sketch value, and the
shingles of candidates alone meet those of their items by a second join.

Words are runs of letters and digits, lower-cased in ASCII. Defined cases: null or wordless items and
documents match nothing; each row of items and documents is reported by itself, also repeated rows and rows of one id with several texts;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx

WIDTH = 5
#: Percent of an item's shingles that a document must contain.
CONTAINED = 80
BLOCK = 500_000
OUT = "doc_id long, item_id long, n_item long, n_found long"
_SEED = np.uint64(0xA0761D6478BD642F)


def _item_rows(width: int):
    """The distinct shingles of each item row and the place of each in the item's order of MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                starts, _ = tx.word_spans(data, bounds, tx.NOT_ALNUM)
                words = np.diff(tx.word_rows(starts, bounds))
                rows, hashes = tx.distinct_shingles(data, bounds, width, tx.NOT_ALNUM)
                order = np.lexsort((tx.mix(hashes ^ _SEED), rows))
                rows, hashes = rows[order], hashes[order]
                sizes = np.bincount(rows, minlength=end - first)
                place = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
                own = batch.slice(first, end - first).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column("item"), own.column("item_id"), pa.array(np.minimum(words, width)[rows], pa.int64()), pa.array(sizes[rows], pa.int64()), pa.array(hashes.view(np.int64)), pa.array(place, pa.int64())],
                    names=["item", "item_id", "width", "n_item", "hash", "place"],
                )

    return run


def _shingles(data: np.ndarray, bounds: np.ndarray, widths: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all shingles of ``widths`` words; those below ``width`` count as whole short texts."""
    starts, ends = tx.word_spans(data, bounds, tx.NOT_ALNUM)
    words = tx.span_hashes(data, starts, ends, True)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(tx.word_rows(starts, bounds)))
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for w in widths:
        h = tx.windows(words, w) if w == width else tx.sequences(words, w)
        if len(h):
            whole = row[: len(h)] == row[w - 1 :][: len(h)]
            rows.append(row[: len(h)][whole])
            hashes.append(h[whole])
    return np.concatenate(rows), np.concatenate(hashes)


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))[: len(rows)]
    return rows[new], hashes[new]


class _Items:
    """Sketches and sets of a bounded number of item shingles, as arrays."""

    def __init__(self, table, width: int, percent: int):
        self.width, self.percent = width, percent
        self.widths = sorted(set(table.width.tolist()))
        item, hashes = table.item.to_numpy(), table["hash"].to_numpy(np.int64).view(np.uint64)
        _, at, self.owner_all = np.unique(item, return_index=True, return_inverse=True)
        self.ids, self.sizes = table.item_id.to_numpy()[at], table.n_item.to_numpy()[at]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner_all = hashes[order], self.owner_all[order]
        self.sketched = (table.place.to_numpy() < depth(table.n_item.to_numpy(), percent))[order]
        #: a bit for the low 20 bits of each shingle of an item
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes & np.uint64(len(self.maybe) - 1)] = True

    def found(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and number of shingles found, of candidates by their sketch that hold the share asked for."""
        rows, hashes = _shingles(data, bounds, self.widths, self.width)
        some = self.maybe[hashes & np.uint64(len(self.maybe) - 1)]
        rows, hashes = _distinct(rows[some], hashes[some])
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = hi - lo
        place = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(rows, n) * np.int64(len(self.ids)) + self.owner_all[place]
        pairs, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        candidate = np.bincount(which, weights=self.sketched[place], minlength=len(pairs)) > 0
        row, item = pairs // len(self.ids), pairs % len(self.ids)
        ok = candidate & (100 * count >= self.percent * self.sizes[item])
        return row[ok], item[ok], count[ok]


def depth(n, percent: int):
    """Sketch depth for items of ``n`` shingles: that of the upper size of their partition."""
    upper = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    return upper * (100 - percent) // 100 + 1


def _found(items: _Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                row, item, count = items.found(data, bounds)
                docs = batch.column("doc_id").slice(first, end - first).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([docs, pa.array(items.ids[item], pa.int64(), from_pandas=True), pa.array(items.sizes[item], pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "item_id", "n_item", "n_found"])

    return run


def _document_shingles(width: int, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                rows, hashes = _distinct(*_shingles(data, bounds, widths, width))
                own = batch.slice(first, end - first).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column("doc"), own.column("doc_id"), pa.array(hashes.view(np.int64))], names=["doc", "doc_id", "hash"])

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = CONTAINED, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_item, n_found for each document that holds at least ``percent`` of an item."""
    with tx.scratch():
        numbered = tx.written(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
        items = tx.written(numbered.mapInArrow(_item_rows(width), "item long, item_id long, width long, n_item long, hash long, place long"), "item-shingles")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if items.count() > block:
            return tx.written(_joined(docs, items, width, percent), "contained", keep=True)
        # at most ``block`` rows
        held = _Items(items.toPandas().astype({"item_id": "Int64"}), width, percent)
    return docs.mapInArrow(_found(held), OUT) if len(held.ids) else docs.sparkSession.createDataFrame([], OUT)


def _joined(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    widths = [r.width for r in items.select("width").distinct().collect()]  # ``width`` rows at most
    numbered = tx.written(docs.filter("text is not null").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "documents")
    shingles = numbered.mapInArrow(_document_shingles(width, widths), "doc long, doc_id long, hash long")
    # a document's other shingles are left out
    wanted = items.select("hash").distinct()
    own = tx.written(shingles.join(wanted, "hash", "left_semi"), "document-shingles")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item"))).cast("long")
    sketch = items.filter(F.col("place") < F.floor(upper * (100 - percent) / 100) + 1).select("item", "hash")
    candidates = tx.written(own.select("doc", "hash").join(sketch, "hash").select("doc", "item").distinct(), "candidates")
    sets = items.select("item", "item_id", "n_item", "hash")
    # the shingles of a candidate's items meet those of the document
    met = candidates.join(sets, "item").join(own, ["doc", "hash"])
    counted = met.groupBy("doc", "doc_id", "item", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_found"))
    return counted.filter(100 * F.col("n_found") >= percent * F.col("n_item")).select("doc_id", "item_id", "n_item", "n_found")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
short AS (SELECT DISTINCT len(ws) AS n FROM i WHERE len(ws) BETWEEN 1 AND 4),
di AS (SELECT rid, doc_id, 5 AS n, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')))) AS g FROM d WHERE len(ws) >= 5
  UNION ALL SELECT rid, doc_id, n, unnest(list_distinct(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' ')))) FROM d JOIN short ON len(ws) >= n),
ii AS (SELECT iid, item_id, least(len(ws), 5) AS n, list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS gs FROM i WHERE len(ws) > 0),
iu AS (SELECT iid, item_id, n, len(gs) AS n_item, unnest(gs) AS g FROM ii)
SELECT doc_id, item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_found FROM di JOIN iu USING (n, g) GROUP BY rid, doc_id, iid, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
