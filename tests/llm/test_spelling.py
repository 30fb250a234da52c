"""Spelling variants against plain versions: all pairs, the query with its SQL, hot initial states, ties, chains and very long words."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from junctura.llm import registry, spelling, text as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_pairs(words):
    return {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}


def plain_groups(n, times=5):
    near = {w: [b for a, b in plain_pairs(n) if a == w] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def vocabulary(rng, size):
    words = set()
    while len(words) < size:
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(1, 9)))
        words.add(w)
    return {w: rng.choice([1, 2, 5, 6, 30, 150, 900]) for w in sorted(words)}


@pytest.mark.parametrize(("depth", "most"), [(0, 5), (1, 2000), (1, 4), (3, 6)])
def test_near_words_equal_all_pairs_of_one_edit(spark, depth, most):
    n = vocabulary(random.Random(depth + most), 400)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    with tx.scratch():
        got = [(r.word, r.near) for r in spelling.near_words(words, depth=depth, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(n)


def test_groups_follow_forms_to_the_last(spark):
    chain = {"m" * (6 - i) + "n" * i: 5**i for i in range(7)}
    ties = {"kitten": 3, "sitten": 15, "kittan": 15, "mitten": 14, "lonely": 9}
    n = chain | ties | vocabulary(random.Random(3), 150)
    with tx.scratch():
        got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == plain_groups(n)
    by = {r[0]: r for r in got}
    assert by["mmmmmm"][2] == "nnnnnn" and by["kitten"][1] == "kittan" and by["lonely"][1] is None


def test_a_third_of_all_words_in_one_initial_state(spark):
    rng = random.Random(5)
    hot = {"prefix" + "".join(rng.choice("ab") for _ in range(9)) + "suffix": rng.randint(1, 40) for _ in range(500)}
    n = hot | vocabulary(rng, 200)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    with tx.scratch():
        states = spelling.initial_states(words, most=20)
        assert states.groupBy("key").count().agg(F.max("count")).first()[0] <= 20
        got = {(r.word, r.near) for r in spelling.near_words(words, most=20).collect()}
    assert got == plain_pairs(n)


def test_very_long_words(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abc") for _ in range(60_000))
    n = {long: 50, long[:-1]: 4, long[:30_000] + "z" + long[30_001:]: 3, long + "z": 2, "x" + long[5:]: 1}
    with tx.scratch():
        got = {r.word: (r.n_near, r.form == long) for r in spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {w: (3, False) if w == long else (0, False) if w[0] == "x" else (1, True) for w in n}


def test_query_equals_sql_and_plain_version(spark, tmp_path):
    rng = random.Random(7)
    stems = ["banana", "Colour", "èrreurs", "gesund", "straße", "aaaaaaa", "x×÷yzab", "formung"]
    texts = []
    for _ in range(300):
        words = []
        for _ in range(12):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :], w[:i] + rng.choice("ab") + w[i:]])
            words.append(w)
        texts.append(rng.choice([" ", "\n", "-", "1", "Ā"]).join(words))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "banana banana Banana", None, None, None), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (9, texts[9], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.withColumns({c: F.lit(3) for c in ("word", "run", "n", "c", "key", "window")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, (tuple(r) for r in registry.QUERIES["op13_spelling"](spark, str(tmp_path)).collect())))
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in spelling_runs(text or ""):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    assert got == sorted(map(str, plain_groups(n))) and len(got) > 60
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(registry.ORACLE_SQL["op13_spelling"]).fetchall()))


def spelling_runs(text):
    return [r.translate(str.maketrans(spelling.UPPER, spelling.LOWER)) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_spelling_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert spelling.op13_spelling(spark, str(tmp_path)).count() == 0
