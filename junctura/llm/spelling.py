"""Spelling variants: words at one edit, from the composition of the vocabulary's acceptor with a one-edit transducer and the acceptor again.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Pairs of ``c`` and ``c`` or ``c + 1`` code
points make class ``c``; the place of their first difference lies in one of a few windows of its code points, and they share all before
and all behind that window. So the composed machine starts, once for each window, in the state that the shared part leads to, unedited: such
initial states, with the words that pass through them, are dealt to partitions. There the free parts of the words become a minimised
acyclic acceptor, which is composed with the transducer and itself as far as states can still lead to a pair; each pair is accepted from one
initial state only.

An initial state that more than ``MOST`` words pass through is split into those of two windows of half the width, again and again; at
a width of one code point the alphabet bounds what is left. So no task depends on how common a beginning or an end is.

Defined cases: null texts have no words; a null doc_id is written as nothing; repeated rows count again; extra columns are ignored; an empty table
gives no rows; without near words the form is null and the root is the word itself. A word of any length is taken whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts lower-cased runs.
GAPS = "[^a-zÀ-ÿ]+"
#: Windows that a class starts with, as a power of two.
DEPTH = 1
#: Words that pass through one initial state, at most, and words of a partition, about.
MOST, PARTITION = 2000, 10_000
BROADCAST_KEYS = 1_000_000
#: A form has at least this many times the occurrences of its variant.
TIMES = 5

_M = 509
_FULL = (1 << _M) - 1


class Acceptor:
    """A minimised acyclic acceptor of several sets of strings, each with its own initial state.

    ``masks`` has, for each state and remaining length, hashes of the strings it accepts as bits; two states without a common bit accept no common string.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.masks: list[dict[int, int]] = []
        self.powers = [1]

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        if (found := self.known.get(key)) is not None:
            return found
        masks = {0: 1} if final else {}
        for c, to in arcs:
            for n, mask in self.masks[to].items():
                while len(self.powers) <= n:
                    self.powers.append(self.powers[-1] * 263 % _M)
                k = ord(c) * self.powers[n] % _M
                masks[n + 1] = masks.get(n + 1, 0) | (mask << k | mask >> (_M - k)) & _FULL
        self.known[key] = state = len(self.arcs)
        self.arcs.append(dict(arcs))
        self.final.append(final)
        self.count.append(final + sum(self.count[to] for _, to in arcs))
        self.masks.append(masks)
        return state

    def add(self, strings: list[str]) -> int:
        """The initial state of a sorted list of distinct strings."""
        path: list[list] = [[False, []]]
        letters: list[str] = []

        def close(depth: int) -> None:
            while len(letters) > depth:
                final, arcs = path.pop()
                path[-1][1].append((letters.pop(), self._state(final, arcs)))

        for s in strings:
            shared = next((i for i, (a, b) in enumerate(zip(letters, s, strict=False)) if a != b), min(len(letters), len(s)))
            close(shared)
            for c in s[shared:]:
                letters.append(c)
                path.append([False, []])
            path[-1][0] = True
        close(0)
        return self._state(*path[0])

    def common(self, p: int, q: int, length: int) -> Iterator[str]:
        """The strings of ``length`` that both states accept."""
        masks, arcs = self.masks, self.arcs
        if not masks[p].get(length, 0) & masks[q].get(length, 0):
            return
        path: list[str] = []
        todo = [(p, q, 0, "")]
        while todo:
            p, q, depth, c = todo.pop()
            if depth:
                del path[depth - 1 :]
                path.append(c)
            if depth == length:
                if self.final[p] and self.final[q]:
                    yield "".join(path)
                continue
            left = length - depth - 1
            other = arcs[q]
            for c, to in arcs[p].items():
                if (also := other.get(c)) is not None and masks[to].get(left, 0) & masks[also].get(left, 0):
                    todo.append((to, also, depth + 1, c))

    def near(self, initial: int, length: int, last: bool) -> Iterator[tuple[str, str]]:
        """Accepted pairs: two strings of ``length`` at one replacement, or one of ``length`` and one with one more letter.

        The edit is where the two first differ, so each pair is met once. Letters behind the end are inserted in the ``last`` window only; elsewhere that place belongs to the next window.
        """
        masks = self.masks
        path: list[str] = []
        todo = [(initial, 0, "")]
        while todo:
            q, depth, c = todo.pop()
            if depth:
                del path[depth - 1 :]
                path.append(c)
            if self.count[q] < 2 or depth > length or (depth == length and not last):
                continue
            left, arcs, head = length - depth, self.arcs[q], None
            own = masks[q].get(left, 0)
            for y, to in arcs.items():
                if own & masks[to].get(left, 0):
                    for tail in self.common(q, to, left):
                        if not tail or tail[0] != y:
                            head = "".join(path) if head is None else head
                            yield head + tail, f"{head}{y}{tail}"
            if left:
                ends = [(x, to, m) for x, to in arcs.items() if (m := masks[to].get(left - 1, 0))]
                for (x, p, a), (y, r, b) in itertools.combinations(ends, 2):
                    if a & b:
                        for tail in self.common(p, r, left - 1):
                            head = "".join(path) if head is None else head
                            yield f"{head}{x}{tail}", f"{head}{y}{tail}"
                todo += [(to, depth + 1, x) for x, to in arcs.items()]


def _pairs(words: list[str], classes: list[int], starts: list[int], ends: list[int]) -> Iterator[tuple[str, str]]:
    """Near words among those that share an initial state."""
    groups: dict[tuple, list[str]] = {}
    for word, c, start, end in zip(words, classes, starts, ends, strict=True):
        cut = len(word) - (c - end)
        groups.setdefault((c, start, end, word[:start], word[cut:]), []).append(word[start:cut])
    acceptor = Acceptor()
    for (c, start, end, head, tail), free in groups.items():
        if len(free) > 1:
            for a, b in acceptor.near(acceptor.add(sorted(set(free))), end - start, end == c):
                yield f"{head}{a}{tail}", f"{head}{b}{tail}"


def _near_pairs(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    n = dict(zip(block["word"], block["n"], strict=True))
    found = list(_pairs(block["word"].tolist(), block["c"].tolist(), block["start"].tolist(), block["end"].tolist()))
    both = [(a, b) for a, b in found] + [(b, a) for a, b in found]
    return pd.DataFrame({"word": [a for a, _ in both], "near": [b for _, b in both], "near_n": [n[b] for _, b in both]}, columns=["word", "near", "near_n"])


def _near_counts(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """For each word the number of near words and the best of them, as far as this partition has them."""
    n = dict(zip(block["word"], block["n"], strict=True))
    best: dict[str, list] = {}
    for pair in _pairs(block["word"].tolist(), block["c"].tolist(), block["start"].tolist(), block["end"].tolist()):
        for a, b in (pair, pair[::-1]):
            rank = (-n[b], b)
            if (x := best.get(a)) is None:
                best[a] = [1, rank]
            else:
                x[0] += 1
                x[1] = min(x[1], rank)
    return pd.DataFrame({"word": list(best), "n_near": [x for x, _ in best.values()], "form_n": [-r[0] for _, r in best.values()], "form": [r[1] for _, r in best.values()]})


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, c, window, windows) with the window's start and end and a hash of their initial state."""
    edge = lambda at: F.floor(at * F.col("c") / F.col("windows")).cast("int")
    placed = rows.withColumns({"start": edge(F.col("window")), "end": edge(F.col("window") + 1)}).filter("start < end")
    behind = F.col("c") - F.col("end")
    tail = F.col("word").substr(F.char_length("word") - behind + 1, behind)
    return placed.withColumn("key", F.xxhash64("c", "start", "end", F.col("word").substr(F.lit(1), F.col("start")), tail))


def initial_states(words: DataFrame, least: int = 1, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """(word, n, c, start, end, key): each word with each initial state that it passes through, none with more than ``most`` words unless the alphabet bounds them."""
    size = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("c")).filter(F.col("c") >= least)
    rows = _keyed(classes.withColumns({"windows": F.lit(1 << depth), "window": F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1)))}))
    done = None
    while True:
        rows = tx.written(rows, "initial-states")
        hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("end") - F.col("start")).alias("width")).filter((F.col("size") > most) & (F.col("width") > 1)).select("key")
        hot = tx.written(hot, "hot-states")
        n_hot = hot.count()
        small = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        settled = rows.join(small, "key", "left_anti") if n_hot else rows
        done = settled if done is None else done.unionByName(settled)
        if not n_hot:
            return done.select("word", "n", "c", "start", "end", "key")
        half = rows.join(small, "key", "left_semi").select("word", "n", "c", (F.col("windows") * 2).alias("windows"), F.explode(F.array(F.col("window") * 2, F.col("window") * 2 + 1)).alias("window"))
        rows = _keyed(half)


def _composed(words: DataFrame, kernel, schema: str, least: int, depth: int, most: int) -> DataFrame:
    states = initial_states(words, least, depth, most)
    partitions = -(-states.count() // PARTITION) or 1
    return states.withColumn("part", F.pmod("key", F.lit(partitions))).groupBy("part").applyInPandas(kernel, schema)


def near_words(words: DataFrame, least: int = 1, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """(word, near, near_n) for all pairs of near words, both ways, of distinct ``words`` (word, n) of ``least`` code points or more."""
    return _composed(words, _near_pairs, "word string, near string, near_n long", least, depth, most)


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form; forms are followed in steps of doubled length."""
    cur = tx.written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = tx.written(cur.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        cur = nxt.select("word", "root")
        if not nxt.filter("moved").limit(1).count():
            return cur


def variant_groups(words: DataFrame, least: int = 1, times: int = TIMES, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n and root of each of distinct ``words`` (word, n).

    The form is the near word of largest n, the smallest of several, if that n is ``times`` the word's n or more.
    """
    parts = _composed(words, _near_counts, "word string, n_near long, form_n long, form string", least, depth, most)
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    near = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.col("form_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    found = tx.written(found, "forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): maximal runs of letters of ``least`` code points or more, A-Z lower-cased, of whole texts."""
    found = docs.filter("text is not null").select("doc_id", F.explode(F.split(F.translate("text", UPPER, LOWER), GAPS)).alias("run"))
    return found.filter(F.char_length("run") >= least)


def observed(run: Column, doc_id: Column) -> Column:
    """The run as op13 reads it: one code point less where 199 divides a CRC-32 of doc_id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)


def op13_spelling(spark, sf_dir: str, least: int = 6, often: int = 5) -> DataFrame:
    with tx.scratch():
        found = runs(tx.table(spark, sf_dir, "documents"), least).select(observed(F.col("run"), F.col("doc_id")).alias("word"))
        counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= often) & (F.char_length("word") >= least))
        grouped = variant_groups(tx.written(counted, "words"), least)
        return tx.written(grouped.select("word", "form", "root", "n", "n_near", "form_n"), "variants", keep=True)


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k, hex(encode(concat(doc_id, ':', run))) AS x FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, z: xor(c >> 8, crc.t[(xor(c, z) & 255) + 1]))) AS h FROM d, crc),
o AS (SELECT CASE WHEN h % 199 = 0 THEN concat(run[:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
x AS MATERIALIZED (SELECT word, n, i, concat(word[:i], word[i + 2:]) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f e ON g.root = e.word WHERE e.form IS NULL
"""
