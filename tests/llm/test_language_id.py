"""Cross-parsing against a plain version that searches the sample's pieces, held-out accuracy, and defined cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from junctura.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_normal(text):
    out = bytes(b if b >= 128 or chr(b).isalpha() else 0 for b in (text or "").lower().encode())
    return re.sub(rb"\x00+", b"\x00", out).lstrip(b"\x00")


def plain_cost(data, pieces):
    phrases = 0
    for at in range(0, len(data), li.STRETCH):
        part = data[at : at + li.STRETCH]
        i = 0
        while i < len(part):
            j = i + 1
            while j < len(part) and any(part[i : j + 1] in p for p in pieces) and any(part[i:j] in p for p in pieces):
                j += 1
            phrases += 1
            i = j
    return phrases * math.log2(sum(len(p) + 1 for p in pieces) + 1) / max(len(data), 1)


def samples(rng):
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    return {k: [plain_normal(text(a, 30)) for _ in range(3)] for k, a in {"aa": "abcdé", "bb": "abxyz", "cc": "ñoпр"}.items()}


def test_costs_equal_a_plain_parse():
    rng = random.Random(2)
    pieces = samples(rng)
    model = li.Model(pieces)
    texts = ["", "  ", "a", "ABC, dé abc!", "q7q q", "日本", None, "abx " * 700, "É" * 1100, *(" ".join("".join(rng.choice("abcdéxyzñoпрq ") for _ in range(9)) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    (part,) = li.normalised(pa.array(texts, pa.string()), 1 << 40)
    _, _, data, bounds = part
    assert [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain_normal(t) for t in texts]
    want = [[plain_cost(plain_normal(t), pieces[k]) for k in model.langs] for t in texts]
    assert np.allclose(model.costs(data, bounds), want)


def test_slices_do_not_change_what_is_read():
    texts = ["ab c" * 50, None, "", "ÉÈ x", "1 2", "z" * 500] * 3
    whole = [d[a:b].tobytes() for _, _, d, bounds in li.normalised(pa.array(texts), 1 << 40) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    cut = [d[a:b].tobytes() for _, _, d, bounds in li.normalised(pa.array(texts), 64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert cut == whole == [plain_normal(t) for t in texts]


def test_suffix_automaton_accepts_all_substrings():
    rng = random.Random(4)
    codes = [rng.randint(1, 3) for _ in range(200)]
    arcs = li.suffix_automaton(codes)
    assert len(arcs) <= 2 * len(codes)
    seen = {tuple(codes[i:j]) for i in range(200) for j in range(i, min(i + 7, 201))}
    for n in range(1, 6):
        for _ in range(200):
            word, state = tuple(rng.randint(1, 3) for _ in range(n)), 0
            for c in word:
                state = arcs[state].get(c) if state is not None else None
            assert (state is not None) == (word in seen)


def test_sample_is_bounded_and_of_distinct_rows(spark):
    rows = [(i % 50, "hot text of many copies " * 40, "en") for i in range(2000)] + [(i, f"{i} ein anderer text {i * 7} " * 80, "de") for i in range(300)]
    pieces = li.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, 4096)
    assert set(pieces) == {"en", "de"} and all(sum(map(len, p)) <= 4096 and len(set(p)) == len(p) for p in pieces.values())
    small = li.Model(li.bounded(pieces, 50_000))
    assert 10_000 < sum(t.nbytes for t in small.tables) <= 50_000


def test_held_out_documents_get_their_language(spark, sf_dir):
    got = {r.doc_id: r for r in li.op12_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs) and len(held) > 20
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_defined_cases(spark, tmp_path):
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "la" if i % 2 else "lz", "s", 1) for i in range(60)]
    rows += [(100, None, "la", "s", 0), (101, "", "la", None, 0), (102, "12 34 !?", None, "s", 8), (103, "Abc ABE", None, None, None), (103, "Abc ABE", None, None, None), (None, "xyz " * 30_000, "la", "s", 1), (104, "日本語", None, "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("held_out", "lang_pred", "score", "row", "rank", "piece", "n", "place", "lettered")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = li.op12_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[k].lang_pred, by[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103].lang_pred == "la" and by[None].lang_pred == "lz" and by[None].held_out and by[104].lang_pred == "la" and by[104].score == 0.5
    assert all(r.lang_pred == ("la" if r.doc_id % 2 else "lz") for r in got if r.doc_id is not None and r.doc_id < 60)


def test_nothing_labelled_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "some text", None, "s", 9)], SCHEMA).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    (r,) = li.op12_language_id(spark, str(tmp_path / "a")).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0) and li.op12_language_id(spark, str(tmp_path / "b")).count() == 0
