"""Toxicity from a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, strips accents, maps homoglyphs (Cyrillic, Greek, full width) and digit or
symbol substitutions to letters and everything else to blanks; ``l``, ``i``, ``1`` and ``|`` fold
alike, so ``1d1ot`` and ``idiot`` are one. The lexicon is learned from labelled rows: words and
word beginnings (stems of ``STEMS`` letters, which catch inflected forms) that are significantly over-represented in toxic documents
are its terms, as many as there are, and a ridge logistic regression on their counts gives the weights, none below 0. The
terms found in a document add up, each by the logarithm of its number, except inside an exception
phrase; the sum is normalised by the logarithm of the length and mapped to a score by a logistic
curve fitted on the same rows.

The labelled rows are bounded by ``max_rows`` (those of the smallest hash of doc_id).

Defined cases: null text counts as empty and gets the score of a text without matches; without labelled rows the
lexicon is empty and all scores are equal; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx

MAX_ROWS = 20_000
MIN_DOCS = 4
MIN_ODDS = 1.2
#: Least significance of a term: documents by log odds, as of a likelihood ratio.
SURE = 12.0
#: Letters of a stem; a whole word of any length is a term, too.
STEMS = (4, 12)
#: Phrases in which a term is not meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown fishes", "pond scum", "stupid simple", "loser bracket", "losers bracket")

#: Look-alike letters and substitutions, each with the letter it stands for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "ß": "s", "ø": "o", "đ": "d", "ł": "i", "æ": "a", "œ": "o",
}


class _Fold(dict):
    """Code point to folded letter, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = LOOKALIKES.get(c, c)
        if not ("a" <= c <= "z" and len(c) == 1):
            base = unicodedata.normalize("NFKD", c)
            c = "".join(x for x in base if not unicodedata.combining(x))[:1].lower()
            c = LOOKALIKES.get(c, c)
            if unicodedata.combining(chr(code)):
                c = ""
            elif not c.isalnum():
                c = " "
        self[code] = c
        return c


_FOLD = _Fold()
#: A mark that ends a word is no letter, although the same character inside a word stands for one.
_EDGE = re.compile(r"[!|$@]+(?=\s|$)|(?<=[a-zA-Z])!+")


def fold(text: str) -> str:
    """The folded text with a blank at either end; words are separated by blanks."""
    if "!" in text or "$" in text or "|" in text or "@" in text:
        text = _EDGE.sub(" ", text)
    return f" {text.translate(_FOLD)} "


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words (with a blank at the end) and word beginnings of each labelled document."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(fold(text or "").split())
            found = {f"{w} " for w in words if len(w) > 2} | {w[:n] for w in words for n in range(STEMS[0], min(len(w), STEMS[1]) + 1)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["term", "toxic"])


def candidate_terms(train: DataFrame) -> list[str]:
    """Terms with a leading blank, of which a chain of beginnings with like counts keeps one; the labelled rows bound their number."""
    total = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not total.t or total.t == total.n:
        return []
    counted = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("t") + 0.5) / (total.t + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (total.n - total.t + 1))
    good = counted.filter(F.col("t") >= MIN_DOCS).select("term", "t", odds.alias("w")).filter((F.col("w") >= MIN_ODDS) & (F.col("t") * F.col("w") >= SURE))
    rows = {r.term: r for r in good.collect()}
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()  # of the chosen terms
    reach: dict[str, int] = {}  # most documents of a chosen term that begins so
    for term in sorted(rows, key=lambda x: (-round(rows[x].t * rows[x].w, 6), -len(x), x)):
        stem, own = term.rstrip(), rows[term]
        # a longer term must be a good deal surer than a chosen beginning of it, a shorter one reach many more documents
        begun = [chosen[c] for n in range(1, len(stem) + 1) for c in (stem[:n], f"{stem[:n]} ") if c in chosen]
        if any(own.w < w + 1.0 for w in begun) or stem in beginnings and own.t < 1.25 * reach[stem]:
            continue
        chosen[term] = own.w
        for n in range(1, len(stem) + 1):
            beginnings.add(stem[:n])
            reach[stem[:n]] = max(reach.get(stem[:n], 0), own.t)
    return [f" {c}" for c in chosen]


def learn_lexicon(train: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict[str, float]:
    """Term (a leading blank marks the beginning of a word) to weight; ``train`` has text and toxic."""
    terms = sorted(candidate_terms(train))
    if not terms:
        return {}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(dict.fromkeys(terms, 1.0), exceptions)
        for batch in batches:
            found = [found_terms(machine, t or "") for t in batch.column("text").to_pylist()]
            at, n = [list(x[0]) for x in found], [[math.log2(1 + v) / math.log2(4 + x[1]) for v in x[0].values()] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["toxic", "at", "n"])

    seen = train.mapInArrow(counts, "toxic int, at array<int>, n array<float>").toPandas()  # as many rows as the sample has
    sizes = seen["at"].map(len).to_numpy()
    cells = (np.repeat(np.arange(len(seen)), sizes), np.concatenate([np.zeros(0, np.int32), *seen["at"]]).astype(np.int64), np.concatenate([np.zeros(0, np.float32), *seen["n"]]).astype(float))
    w = _ridge_logistic(*cells, seen.toxic.to_numpy(float), len(terms))
    return {t: float(v) for t, v in zip(terms, w, strict=False) if v > 1e-3}


def _ridge_logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, n: int, ridge: float = 0.05) -> np.ndarray:
    """Weights of ``n`` features, and the intercept, of a logistic regression on the cells of a sparse matrix.

    Newton's method, each step by conjugate gradients, so memory is that of the cells, whatever the number of features.
    """
    w = np.zeros(n + 1)
    penalty = np.append(np.full(n, ridge), 1e-6)
    along = lambda v: np.bincount(row, value * v[col], len(y)) + v[-1]
    across = lambda r: np.append(np.bincount(col, value * r[row], n), r.sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(along(w), -30, 30)))
        gradient, curve = penalty * w + across(p - y), p * (1 - p) + 1e-9
        diagonal = penalty + np.append(np.bincount(col, value * value * curve[row], n), curve.sum())
        step, left = np.zeros(n + 1), gradient.copy()
        scaled = left / diagonal
        go, size = scaled.copy(), float(left @ scaled)
        for _ in range(500):
            if size < 1e-18:
                break
            bent = penalty * go + across(curve * along(go))
            t = size / float(go @ bent)
            step, left = step + t * go, left - t * bent
            scaled = left / diagonal
            new = float(left @ scaled)
            go, size = scaled + new / size * go, new
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, (term, weight) in enumerate(sorted(lexicon.items())):
        out.add_word(term, (i, weight, len(term)))
    for phrase in exceptions:
        p = f"{fold(phrase).rstrip()} "
        out.add_word(p, (-1, 0.0, len(p)))
    out.make_automaton()
    return out


def found_terms(machine, text: str) -> tuple[dict[int, int], int]:
    """How often each term was found outside of exception phrases, and the number of words."""
    folded = fold(text)
    times: dict[int, int] = {}
    spans, hits = [], []
    for end, (i, _, size) in machine.iter(folded):
        if i < 0:
            spans.append((end - size + 1, end))
        else:
            hits.append((end, i, size))
    spans.sort()
    begins, reach = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))
    for end, i, size in hits:
        # the phrases that begin at or before the term; the farthest of them holds it or none does
        k = bisect.bisect_right(begins, end - size + 1)
        if not k or reach[k - 1] < end:
            times[i] = times.get(i, 0) + 1
    return times, folded.count(" ")


def matched(machine, weights: list[float], text: str) -> tuple[float, int]:
    """Sum of the weights found, and the number of words."""
    times, words = found_terms(machine, text)
    return sum(weights[i] * math.log2(1 + n) for i, n in times.items()), words


def _normal(total: float, words: int) -> float:
    return total / math.log2(4 + words)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a small ridge."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Text and label of at most ``max_rows`` labelled rows outside the held-out fold, chosen by a hash of doc_id; of several texts of a doc_id the first in order."""
    picked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).dropDuplicates(["doc_id"])
    picked = picked.sort(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))  # max_rows bounds the broadcast


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with tx.scratch():
        train = tx.written(training_rows(docs, labels, "toxic", max_rows).select("text", "toxic"), "toxicity-train")
        lexicon = learn_lexicon(train, exceptions)
        weights = [w for _, w in sorted(lexicon.items())]
        a, b = _calibrated(train, lexicon, weights, exceptions)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            x = np.array([_normal(*matched(machine, weights, t or "")) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(a + b * x, -500, 500))))], names=["doc_id", "score"])

    return docs.mapInArrow(scores, "doc_id long, score double").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _calibrated(train: DataFrame, lexicon: dict[str, float], weights: list[float], exceptions: tuple[str, ...]) -> tuple[float, float]:
    """Intercept and slope of the curve from normalised sums to scores."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            x = [_normal(*matched(machine, weights, t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.float64())], names=["toxic", "x"])

    seen = train.mapInArrow(values, "toxic int, x double").toPandas()  # max_rows at most
    return _fit(seen.x.to_numpy(float), seen.toxic.to_numpy(float)) if len(seen) else (0.0, 0.0)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "labels"))
