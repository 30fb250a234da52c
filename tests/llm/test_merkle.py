"""The manifest against a plain version: nulls, ties, repeated rows, clashing columns, and trees of several tiers of superblocks."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from junctura.llm import merkle, registry, text as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 3 * 3
        out.append((nodes[first:i], nodes[i + 1 : first + 3]))
        i //= 3
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees[s] = (own, plain_tree([plain_leaf(r, r[1]) for r in own]))
    top = plain_tree([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, levels = trees[s]
        for i, r in enumerate(own):
            path = siblings(levels, i) + siblings(top, k)
            spoilt = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = plain_leaf(r, r[1].replace("\n", "") if spoilt else r[1])
            for a, b in path:
                node = digest(*a, node, *b)
            out.append((r[0], plain_leaf(r, r[1]), levels[-1][0], top[-1][0], digest(*(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return out


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize(("levels", "n"), [(1, 95), (2, 60), (6, 40)])
def test_manifest_equals_a_plain_one(spark, tmp_path, monkeypatch, levels, n):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a\nb", "", "ä\n\n", None, "plain", "x" * 3000]), rng.choice(["en", None]), rng.choice(["hot"] * 6 + [None, "", "é", "z", "Z", "a|b"]), rng.choice([None, i])) for i in range(n)]
    rows += [rows[0], rows[0], (None, "t\n", None, "hot", 2), (None, "u", None, "hot", None), (5, "other\ntext", "en", "hot", 1), (-3, "\n", "en", "hot", 1), (1000, "alone\n", "en", "lone", 6)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("leaf", "pos", "tree", "number", "_range", "block", "root")})
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, None, True, 3, levels))
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(key, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got))) == sorted(map(key, plain(rows)))
    assert {r.verified for r in got} == {True, False}


def test_proofs_hold_the_siblings_and_a_lone_row_has_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(11)], SCHEMA)
    for r in merkle.manifest(docs, levels=1).collect():
        assert r.verified and digest(*r.proof) == r.proof_sha256 and 2 <= len(r.proof) <= 6
    (lone,) = merkle.manifest(docs.filter("doc_id = 4")).collect()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof == [] and lone.proof_sha256 == digest()


def test_manifest_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.op11_merkle(spark, str(tmp_path)).count() == 0


def test_manifest_query_leaves_no_tables_but_its_own(spark, sf_dir):
    import os

    before = set(os.listdir(tx.shared_dir(spark)))
    assert registry.QUERIES["op11_merkle"](spark, sf_dir).count() > 0
    assert {x.split("-")[0] for x in set(os.listdir(tx.shared_dir(spark))) - before} == {"manifest"}
