"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each document gets integer measures in per mille. A sketch is a histogram with exact small values and
64 to 128 steps for each power of two above, so two sketches merge by adding counts and a quantile is off by less
than 1/64 of its value, whatever the order of merging. The fence of a measure in a group of one language and source is
``upper + SPREAD * (upper - median)``, upper being its 90 % quantile, so that a tenth of a group may be junk; it rests on the data alone.
Groups are shrunk to the typical one: a group of n documents counts n against ``PRIOR`` for the median fence of the sources of its
language, and a language so against the median of all languages. These medians come from sketches of fences.

A document fails where its count exceeds what the fence allows for its length by more than ``sqrt(ALLOWED * (count + 1))``, the chance
spread of a count; short texts are thus not judged by one word.

Defined cases: null text counts as empty (base_failed); null lang or source is a group of its own;
an empty table gives an empty result; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text as tx

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20
SPREAD = 6
PRIOR = 100
ALLOWED = 25
#: Measure: the count and what it is a share of, in per mille.
MEASURES = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "upper": ("n_upper", "word_chars"), "word_length": ("word_chars", "n_words"), "stutter": ("n_stutter", "n_words")}
#: Groups up to which their fences are broadcast, some 100 bytes each; beyond, they are joined by a shuffle whose hot groups Spark can split.
BROADCAST_GROUPS = 100_000
BASE_SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_stutter long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = b" \t\n\r\x0b\x0c"


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeat_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in it."""
    count = np.diff(first)
    hashes = tx.windows(words, WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    n = len(hashes)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :][:n]) if n else np.zeros(0, np.int64)
    rows, hashes = row[at], hashes[at]
    order = np.lexsort((hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return _sums(np.cumsum(cover)[: len(words)] > 0, first)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(8)]
        for first, end, data, bounds in tx.text_slices(batch.column("text")):
            starts, ends = tx.word_spans(data, bounds)
            words = tx.span_hashes(data, starts, ends, False)
            rows = tx.word_rows(starts, bounds)
            lines, dups = [], []
            raw = data.tobytes()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                kept = [x for x in raw[a:b].split(b"\n") if x.strip(_BLANK)]
                lines.append(len(kept))
                dups.append(len(kept) - len(set(kept)))
            stutter = np.zeros(len(words), bool)
            stutter[1:] = words[1:] == words[:-1]
            stutter[rows[:-1][rows[:-1] < len(words)]] = False
            chars = _sums(~tx.SPACES[data] & ((data & 0xC0) != 0x80), bounds)
            for o, x in zip(out, (np.diff(rows), chars, _sums(_SYMBOL[data], bounds), np.array(lines), np.array(dups), _repeat_words(words, rows), _sums(_UPPER[data], bounds), _sums(stutter, rows)), strict=True):
                o.append(np.asarray(x, np.int64))
        if len(batch):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(np.concatenate(o)) for o in out)], names=[c.split()[0] for c in BASE_SCHEMA.split(", ")])


def measures(docs: DataFrame) -> DataFrame:
    """One row per document with its counts."""
    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(_measure, BASE_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _per_mille(name: str) -> Column:
    top, below = MEASURES[name]
    return F.expr(f"case when {below} > 0 then 1000 * {top} div {below} else 0 end")


def sketch_step(value: Column) -> Column:
    """The lower end of the histogram step of a non-negative integer: its seven leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return value - value % unit


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, median and 90 % quantile of sketches (keys, measure, step, n); a sketch has a bounded number of steps, so windows are small."""
    by = Window.partitionBy(*keys, "measure")
    upto = sketch.withColumn("upto", F.sum("n").over(by.orderBy("step"))).withColumn("total", F.sum("n").over(by))
    at = lambda num, den: F.min(F.when(den * F.col("upto") >= num * F.col("total"), F.col("step")))
    return upto.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(1, 2).alias("mid"), at(9, 10).alias("high"))


def _shrunk(n: str, own: str, prior: str) -> Column:
    return F.expr(f"({n} * {own} + {PRIOR} * {prior}) div ({n} + {PRIOR})")


def thresholds(base: DataFrame) -> DataFrame:
    """lang, source and the fence of each measure, from documents that pass the base rules."""
    steps = (
        base.filter(~base_failed())
        .select("lang", "source", F.posexplode(F.array(*[sketch_step(_per_mille(m)) for m in MEASURES])).alias("measure", "step"))
        .groupBy("lang", "source", "measure", "step").agg(F.count(F.lit(1)).alias("n"))
    )
    own = _quantiles(steps, ["lang", "source"]).select("lang", "source", "measure", F.col("total").alias("n_own"), (F.col("high") + SPREAD * (F.col("high") - F.col("mid"))).alias("own"))
    sources = own.groupBy("lang", "measure", sketch_step(F.col("own")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    size = own.groupBy("lang", "measure").agg(F.sum("n_own").alias("n_lang"))
    langs = _quantiles(sources, ["lang"]).select(F.col("lang").alias("k_lang"), F.col("measure").alias("k_measure"), F.col("mid").alias("typical"))
    same_lang = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    langs = langs.join(size, same_lang("k_lang", "lang") & (F.col("k_measure") == F.col("measure"))).select("k_lang", "measure", "n_lang", "typical")
    every = _quantiles(langs.groupBy("measure", sketch_step(F.col("typical")).alias("step")).agg(F.count(F.lit(1)).alias("n")), []).select("measure", F.col("mid").alias("of_all"))
    langs = langs.join(every, "measure").select("k_lang", F.col("measure").alias("k_measure"), _shrunk("n_lang", "typical", "of_all").alias("of_lang"))
    fences = own.join(langs, same_lang("lang", "k_lang") & (F.col("measure") == F.col("k_measure"))).withColumn("fence", _shrunk("n_own", "own", "of_lang"))
    return fences.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == i, F.col("fence"))).alias(f"max_{m}") for i, m in enumerate(MEASURES)])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the fences that applied."""
    with tx.scratch():
        base = tx.written(measures(docs), "quality-measures")
        fences = tx.written(thresholds(base).withColumnsRenamed({"lang": "k_lang", "source": "k_source"}), "fences")
        fences = F.broadcast(fences) if fences.count() <= BROADCAST_GROUPS else fences
        joined = base.join(fences, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left")
        inside = F.lit(True)
        for m, (top, below) in MEASURES.items():
            # a group in which no document passes the base rules has no fence and needs none
            excess = 1000 * F.col(top) - F.coalesce(F.col(f"max_{m}"), F.lit(0)) * F.col(below)
            inside &= (excess <= 0) | (excess.cast("double") * excess.cast("double") <= ALLOWED * 1e6 * (F.col(top) + 1))
        out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), *[f"max_{m}" for m in MEASURES])
        return tx.written(out, "quality", keep=True)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(tx.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
g AS (SELECT rid, i, w, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS g, coalesce(w = lag(w) OVER o, false) AS st FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, w, st, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS twice FROM g),
c AS (SELECT rid, w, st, max(twice::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
wc AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(covered) AS n_repeat_words, sum(st::INT) AS n_stutter FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, coalesce(n_stutter, 0) AS n_stutter FROM docs LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END, CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN 1000 * n_stutter // n_words ELSE 0 END]::BIGINT[] AS v FROM base),
s AS (SELECT lang, source, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM m WHERE NOT base_failed),
st AS (SELECT lang, source, k, x - x % (2 ** greatest(0, length(bin(x)) - 7))::BIGINT AS x FROM s),
q AS (SELECT lang, source, k, quantile_disc(x, 0.9) + 6 * (quantile_disc(x, 0.9) - quantile_disc(x, 0.5)) AS f, count(*) AS n FROM st GROUP BY ALL),
ql AS (SELECT lang, k, quantile_disc(f - f % (2 ** greatest(0, length(bin(f)) - 7))::BIGINT, 0.5) AS f, sum(n)::BIGINT AS n FROM q GROUP BY ALL),
qa AS (SELECT k, quantile_disc(f - f % (2 ** greatest(0, length(bin(f)) - 7))::BIGINT, 0.5) AS f FROM ql GROUP BY ALL),
pl AS (SELECT ql.lang, ql.k, (ql.n * ql.f + 100 * qa.f) // (ql.n + 100) AS f FROM ql JOIN qa USING (k)),
tt AS (SELECT q.lang, q.source, list((q.n * q.f + 100 * pl.f) // (q.n + 100) ORDER BY q.k) AS f FROM q JOIN pl ON pl.lang IS NOT DISTINCT FROM q.lang AND pl.k = q.k GROUP BY ALL),
e AS (SELECT m.*, [n_symbols, n_repeat_words, n_dup_lines, n_upper, word_chars, n_stutter]::BIGINT[] AS top, [n_words, n_words, n_lines, word_chars, n_words, n_words]::BIGINT[] AS below, coalesce(f, [0, 0, 0, 0, 0, 0]) AS f FROM m LEFT JOIN tt ON tt.lang IS NOT DISTINCT FROM m.lang AND tt.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
NOT base_failed AND len(list_filter(range(1, 7), lambda k: 1000 * top[k] > f[k] * below[k] AND (1000 * top[k] - f[k] * below[k])::DOUBLE * (1000 * top[k] - f[k] * below[k])::DOUBLE > 25e6 * (top[k] + 1))) = 0 AS kept
FROM e
"""
