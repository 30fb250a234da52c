"""Language identification by cross-parsing entropy.

Of each language a sample of labelled text makes a suffix automaton. A text is parsed with each automaton into the longest phrases that
occur in the language's sample; their number, times the logarithm of the sample's size and divided by the text's length, estimates the bits
that a letter of the text costs in that language (the cross-parsing estimate of relative entropy). The cheapest language wins.

Texts are lower-cased, and all of ASCII but letters becomes single spaces; the automata read UTF-8 bytes. A text is parsed in stretches of ``STRETCH`` bytes at whose
ends phrases end, all stretches of some megabytes at once: each step looks the next states of all of them up in one table.

The sample is bounded: of each language at most ``SAMPLE_ROWS`` labelled rows of the smallest hashes, of their whole texts the pieces
of the smallest hashes, up to ``SAMPLE_BYTES``, and less where all languages' tables together would exceed ``TABLE_BYTES``.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every text where nothing is labelled; of equally cheap languages the first in code-point order
wins; with one language learned its score is 1; repeated rows are predicted one by one, and learned from once; rows of null doc_id are predicted, not learned from; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import text as tx

SAMPLE_ROWS = 600
SAMPLE_BYTES = 1 << 16
TABLE_BYTES = 192 << 20
PIECE = 512
#: Pieces of one row's text, at most, that come to the choice.
ROW_PIECES = 32
STRETCH = 1024
#: Bytes of text that are parsed at a time.
SLICE = 4 << 20
UNKNOWN = "und"

#: 0 for bytes that part words, else the byte.
_KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)


def normalised(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of the rows in them) of slices of lower-cased texts, runs of other characters as one zero and none first."""
    for first, end, _, _ in tx.text_slices(column, limit):
        part = pc.utf8_lower(column.slice(first, end - first).fill_null("").cast(pa.large_string()))
        for a, b, data, bounds in tx.text_slices(part, 1 << 62):
            code = _KEPT[data]
            after = np.ones(len(code), bool)
            after[1:] = code[:-1] == 0
            after[bounds[:-1][bounds[:-1] < len(code)]] = True
            keep = (code != 0) | ~after
            at = np.zeros(len(code) + 1, np.int64)
            np.cumsum(keep, out=at[1:])
            yield first + a, first + b, code[keep], at[bounds]


# --- the sample ---------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row the pieces of its normalised text with the smallest hashes."""
    for batch in batches:
        out: dict[str, list] = {"lang": [], "rank": [], "piece": []}
        for lang, row, text in zip(batch["lang"], batch["row"], batch["text"], strict=True):
            for _, _, data, _ in normalised(pa.array([text], pa.large_string()), 1 << 62):
                ranks = tx.mix(np.uint64(row & (1 << 64) - 1) + np.arange(-(-len(data) // PIECE), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                for i in np.argsort(ranks, kind="stable")[:ROW_PIECES]:
                    out["lang"].append(lang)
                    out["rank"].append(int(ranks[i] >> np.uint64(1)))
                    out["piece"].append(data[i * PIECE : (i + 1) * PIECE].tobytes())
        yield pd.DataFrame(out)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Pieces of each language's text from ``labelled`` (doc_id, lang, text); the driver gets ``size`` bytes of each language at most."""
    labelled = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # four times the rows that are wanted, so that hardly ever fewer are found
    share = F.least(F.lit(1.0), F.lit(4.0 * rows) / F.col("n"))
    near = labelled.join(F.broadcast(counts), "lang").filter(F.pmod("row", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "row"])
    by = lambda c: F.row_number().over(Window.partitionBy("lang").orderBy(c))
    chosen = near.withColumn("place", by("row")).filter(F.col("place") <= rows).select("lang", "row", "text")
    pieces = chosen.mapInPandas(_pieces, "lang string, rank long, piece binary").dropDuplicates(["lang", "piece"])
    few = pieces.withColumn("place", by("rank")).filter(F.col("place") <= size // PIECE).select("lang", "place", "piece").collect()
    found: dict[str, list[bytes]] = {}
    for r in sorted(few, key=lambda r: (r.lang, r.place)):
        if r.piece:
            found.setdefault(r.lang, []).append(bytes(r.piece))
    return found


def bounded(pieces: dict[str, list[bytes]], table_bytes: int = TABLE_BYTES) -> dict[str, list[bytes]]:
    """The first pieces of each language, as many as fit: a suffix automaton has twice as many states as bytes at most."""
    width = len(set(b"".join(b"".join(p) for p in pieces.values()))) + 3
    each = max(table_bytes // (8 * width) // max(len(pieces), 1), 16)
    out = {}
    for lang, own in pieces.items():
        total, kept = 0, []
        for p in own:
            p = p[: max(each - total - 1, 0)]
            if p:
                total += len(p) + 1
                kept.append(p)
        out[lang] = kept
    return out


# --- suffix automata ----------------------------------------------------------------------------------


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state; 0 is the initial state."""
    arcs: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in codes:
        cur = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return arcs


class Model:
    """For each language a table of what follows a state and a class of bytes: the next state's place, and the phrases that end, in the two lowest bits.

    Where a phrase cannot go on, the next one begins with the byte; a byte that the sample lacks is a phrase of its own.
    """

    def __init__(self, pieces: dict[str, list[bytes]]) -> None:
        self.langs = sorted(pieces)
        used = sorted(set(b"".join(b"".join(p) for p in pieces.values())))
        #: Classes of bytes: 0 for those of no sample; the last one parts pieces and occurs in no text.
        self.classes = np.zeros(256, np.uint8 if len(used) < 254 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 2
        self.tables, self.bits = [], []
        for lang in self.langs:
            codes: list[int] = []
            for p in pieces[lang]:
                codes += [*self.classes[np.frombuffer(p, np.uint8)].tolist(), width - 1]
            arcs = suffix_automaton(codes)
            first = np.zeros(width, np.int64)
            for c, to in arcs[0].items():
                first[c] = to
            # no way on: the phrase ends, and the byte is a further one where the sample lacks it
            stop = first * width * 4 + 1 + (first == 0)
            table = np.tile(stop.astype(np.uint32), (len(arcs), 1))
            table[0] = np.where(first > 0, first * width * 4, 1)
            for s, own in enumerate(arcs):
                if own:
                    table[s, list(own)] = np.fromiter(own.values(), np.int64, len(own)) * width * 4
            self.tables.append(table.ravel())
            self.bits.append(math.log2(len(codes) + 1))

    def costs(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits a byte (rows, languages) of rows of normalised text; 0 for empty ones."""
        sizes = np.diff(bounds)
        n = -(-sizes // STRETCH)
        row = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = bounds[:-1][row] + nth * STRETCH
        length = np.minimum(sizes[row] - nth * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        start, row, lengths = start[order], row[order], length[order]
        phrases = np.zeros((len(self.tables), len(order)), np.int64)
        if len(order):
            live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # lanes longer than each place
            coded = self.classes[data]
            state = np.zeros_like(phrases, np.uint32)
            for place, k in enumerate(live):
                c = coded[start[:k] + place]
                for i, table in enumerate(self.tables):
                    got = table[state[i, :k] + c]
                    phrases[i, :k] += got & 3
                    state[i, :k] = got >> 2
            phrases += state > 0
        total = np.zeros((len(sizes), len(self.tables)), np.float64)
        for i, bits in enumerate(self.bits):
            total[:, i] = np.bincount(row, phrases[i], len(sizes)) * bits
        return total / np.maximum(sizes, 1)[:, None]


_models: dict[str, Model] = {}


def _model(pieces: dict[str, list[bytes]]) -> Model:
    """One model for each worker, made when its first task begins."""
    key = hashlib.sha256(repr(sorted(pieces.items())).encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(pieces)
    return _models[key]


def _predictor(pieces: dict[str, list[bytes]]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(pieces)
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, end, data, bounds in normalised(batch.column("text")):
                costs = model.costs(data, bounds)
                best[first:end] = costs.argmin(1)
                if len(model.langs) > 1:
                    two = np.partition(costs, 1, axis=1)[:, :2]
                    both = two.sum(1)
                    score[first:end] = np.where(both > 0, two[:, 1] / np.where(both > 0, both, 1), 0.5)
                else:
                    score[first:end] = 1.0
            langs = np.array([*model.langs, UNKNOWN], dtype=object)[np.where(lettered, best, len(model.langs))]
            columns = [batch.column(c) for c in batch.schema.names if c not in ("text", "lettered")]
            names = [c for c in batch.schema.names if c not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(np.where(lettered, score, 0.0))], [*names, "lang_pred", "score"])

    return predict


def predict_language(docs: DataFrame, held_out, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text, lang); languages are learned where ``held_out`` (a column) is false."""
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    pieces = bounded(sample(docs.filter("not held_out"), rows, size))
    if not pieces:
        return docs.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", lettered.alias("lettered"), "text").mapInArrow(_predictor(pieces), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return predict_language(tx.table(spark, sf_dir, "documents"), held_out)
