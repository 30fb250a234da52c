"""Quality by co-training of two views: text content and page metadata.

The content view sees counts of the text (word length, symbols, repeats, repeated lines, capitals,
stutter, function-word share and the like), the metadata view sees language, source and length as
recorded, never the text. Both start from the labelled rows; in each round each view labels the
unlabelled rows it is surest of, in the labels' proportions and only beyond ``SURE``, for the OTHER
view. Each view is then calibrated (Platt) on a fold of labelled rows it was not trained on, and a
logistic combination of the two calibrated logits, fitted on that fold, scores all documents.

Fitting is bounded: ``max_rows`` labelled and as many unlabelled rows, those of the smallest hash of
doc_id. The models are a few hundred numbers.

Defined cases: null text counts as empty; null lang, source and n_chars have a value of their own; without rows of both
labels every document is kept with score 0.5; repeated rows are scored one by one; an empty table gives an empty result; extra columns
stay, but ones named p_text, p_meta, score and kept give way to the results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as tx
from .quality_rules import _repeat_words, _sums, _SYMBOL, _UPPER, _BLANK

MAX_ROWS = 12_000
ROUNDS = 5
PER_ROUND = 600
SURE = 0.95
SOURCES, LANGS = 64, 16
N_TEXT, N_META = 12, 2 + SOURCES + LANGS

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True
_BANG = np.zeros(256, bool)
_BANG[33] = True


def text_view(column: pa.Array) -> np.ndarray:
    """Content measures of each row."""
    out = []
    for first, end, data, bounds in tx.text_slices(column):
        starts, ends = tx.word_spans(data, bounds)
        words = tx.span_hashes(data, starts, ends, False)
        rows = tx.word_rows(starts, bounds)
        n = np.diff(rows).astype(float)
        safe = np.maximum(n, 1)
        chars = _sums(~tx.SPACES[data] & ((data & 0xC0) != 0x80), bounds)
        some = np.maximum(chars, 1)
        stutter = np.zeros(len(words), bool)
        stutter[1:] = words[1:] == words[:-1]
        stutter[rows[:-1][rows[:-1] < len(words)]] = False
        raw = data.tobytes()
        lines, dups = np.zeros(end - first), np.zeros(end - first)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            kept = [x for x in raw[a:b].split(b"\n") if x.strip(_BLANK)]
            lines[i], dups[i] = len(kept), len(kept) - len(set(kept))
        short = _sums((ends - starts) <= 3, rows) / safe
        out.append(np.stack([
            np.log1p(n), chars / safe, np.minimum(_sums(_SYMBOL[data], bounds) / safe, 4), _repeat_words(words, rows) / safe, dups / np.maximum(lines, 1), _sums(_UPPER[data], bounds) / some,
            _sums(stutter, rows) / safe, np.minimum(_sums(_BANG[data], bounds) / safe, 4), _sums(_DIGIT[data], bounds) / some, np.minimum(_sums(_STOP[data], bounds) / safe, 2), short, (n < 10).astype(float),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, N_TEXT))


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Page metadata of each row."""
    x = np.zeros((len(lang), N_META))
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        x[i, 0], x[i, 1] = np.log1p(max(c or 0, 0)), c is None
        x[i, 2 + zlib.crc32(str(b).encode()) % SOURCES] = 1
        x[i, 2 + SOURCES + zlib.crc32(str(a).encode()) % LANGS] = 1
    return x


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        a = self._rows(x)
        self.w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-7:
                break

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._rows(x) @ self.w, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Two views trained on each other's confident labels, and their calibrated combination."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE):
        train, check = ~fold, fold
        share = y[train].mean()
        given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        taken = [np.zeros(len(pool[0]), bool), np.zeros(len(pool[0]), bool)]
        for k in range(rounds + 1):
            self.models = [Logistic(np.concatenate([v[train], *(p[i] for i, _ in g)]), np.concatenate([y[train], *(t for _, t in g)])) for v, p, g in zip(views, pool, given, strict=True)]
            if k == rounds:
                break
            for me, other in ((0, 1), (1, 0)):
                p = _sigmoid(self.models[me].logit(pool[me]))
                for label, rank, quota in ((1.0, -p, share), (0.0, p, 1 - share)):
                    order = np.argsort(rank, kind="stable")
                    order = order[~taken[other][order] & ((p[order] >= sure) if label else (p[order] <= 1 - sure))][: int(per_round * quota) + 1]
                    taken[other][order] = True
                    given[other].append((order, np.full(len(order), label)))
        self.platt = [Logistic(m.logit(v[check])[:, None], y[check], 1e-2) for m, v in zip(self.models, views, strict=True)]
        self.mixer = Logistic(self._logits(tuple(v[check] for v in views)), y[check], 1e-2)

    def _logits(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.stack([c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.platt, self.models, views, strict=True)], axis=1)

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Content, metadata and combined score of each row."""
        z = self._logits(views)
        return np.concatenate([_sigmoid(z), _sigmoid(self.mixer.logit(z))[:, None]], axis=1)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> CoTrained | None:
    """A model from a bounded sample, or None without rows of both labels."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    labelled = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).dropDuplicates(["doc_id"])
    picked = labelled.sort(*order).limit(max_rows)
    known = docs.join(F.broadcast(picked), "doc_id")  # max_rows bounds the broadcast
    others = docs.filter("doc_id is not null").select("doc_id").join(labelled, "doc_id", "left_anti").sort(*order).limit(max_rows)
    pool = docs.join(F.broadcast(others), "doc_id").withColumn("y", F.lit(None).cast("double"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _views(batch)
            x = np.concatenate([a, b], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    sample = known.select("doc_id", "text", "lang", "source", "n_chars", "y").unionByName(pool.select("doc_id", "text", "lang", "source", "n_chars", "y"))
    seen = sample.mapInArrow(rows, "doc_id long, y double, x array<double>").sort("doc_id").toPandas()  # 2 * max_rows at most
    if not len(seen):
        return None
    x = np.array(seen.x.tolist()).reshape(len(seen), N_TEXT + N_META)
    y, ids = seen.y.to_numpy(float), seen.doc_id.to_numpy(np.int64)
    have = ~np.isnan(y)
    fold = (tx.mix(ids[have].view(np.uint64)) % np.uint64(3)) == 0
    for part in (y[have][fold], y[have][~fold]):
        if len(set(part.tolist())) < 2:
            return None
    split = lambda v: (v[:, :N_TEXT], v[:, N_TEXT:])
    return CoTrained(split(x[have]), y[have], fold, split(x[~have]))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """All columns of ``docs`` with p_text, p_meta, score (of good quality) and kept."""
    own = docs.drop("p_text", "p_meta", "score", "kept").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "n_chars": F.col("n_chars").cast("long")})
    model = fit(own.select("doc_id", "text", "lang", "source", "n_chars"), labels, max_rows)
    fields = StructType([*own.schema.fields, *(StructField(c, DoubleType()) for c in ("p_text", "p_meta", "score"))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(_views(batch)) if model else np.full((len(batch), 3), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(3))], names=[*batch.schema.names, "p_text", "p_meta", "score"])
        tx.release_memory()

    return own.mapInArrow(scored, fields).withColumn("kept", F.col("score") >= 0.5)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = tx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return score_documents(docs, tx.table(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "score", "kept")
