"""A Merkle manifest of a table: a leaf for each row, a tree for each source, a tree over the sources' roots.

The rows of a source are numbered over sorted ranges and dealt to superblocks of ``ARITY ** LEVELS`` consecutive ones, which bound
the rows of a task however large a source is. A pass upwards reduces each superblock to its root; the roots are dealt to superblocks in turn, until
one node of a source is left. A pass downwards hands each superblock the outer nodes that its proofs need (the siblings on the path from
its root to the root of all): nodes and outer nodes are cogrouped by superblock, where the local
reduction is done again, the local part of a proof is joined with the outer one, and the proof is folded to a root.

Defined cases: null columns are ``-`` in a leaf; a null source is a source of its own, before all others; null doc_ids come first in their
source; rows of equal doc_id are ordered by their leaf, and repeated rows are leaves of their own; a lone leaf is
its source's root, and a lone source's root is the root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import ranks
from . import text as tx

ARITY = 3
#: Levels of a superblock: 729 leaves.
LEVELS = 6
#: Sources up to this number are sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns, each ``-`` or its number of UTF-8 bytes, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts)), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], n: int, arity: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock and those above them; ``n`` nodes lie on its lowest level in the whole tree."""
    out = [nodes]
    for _ in range(levels):
        if n == 1:
            break
        nodes = [digest(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        n = -(-n // arity)
        out.append(nodes)
    return out


def _paths(levels: list[list[str]], arity: int) -> list[tuple[list[str], list[str]]]:
    """For each lowest node what lies left and right of it and of each node above it, as far as the superblock's root."""
    above: list[tuple[list[str], list[str]]] = [([], [])] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        own = []
        for i in range(len(nodes)):
            first = i - i % arity
            left, right = above[i // arity]
            own.append((["".join(nodes[first:i]), *left], ["".join(nodes[i + 1 : first + arity]), *right]))
        above = own
    return above


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that a node and its siblings give, level by level."""
    for a, b in zip(left, right, strict=True):
        node = digest([a, node, b])
    return node


def _up(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The superblocks' roots, as nodes (tree, pos, n, digest)."""
    width = arity**levels

    def reduced(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        root = _levels(block.sort_values("pos")["digest"].tolist(), n, arity, levels)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // width)], "digest": [root]})

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / width).cast("long"))
    return blocks.groupBy("tree", "block").applyInPandas(reduced, "tree long, pos long, n long, digest string")


OUTER = "tree long, block long, up array<string>, down array<string>, subroot string, root string"


def _down(nodes: DataFrame, outer: DataFrame, arity: int, levels: int) -> DataFrame:
    """Outer nodes for the superblock below each of the nodes."""
    width = arity**levels

    def joined(key: tuple, block: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        o = out.iloc[0]
        paths = _paths(_levels(block["digest"].tolist(), int(block["n"].iloc[0]), arity, levels), arity)
        return pd.DataFrame({
            "tree": block["tree"], "block": block["pos"], "up": [[*a, *o["up"]] for a, _ in paths], "down": [[*b, *o["down"]] for _, b in paths],
            "subroot": o["subroot"], "root": o["root"],
        })

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / width).cast("long"))
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(joined, OUTER)


def _tiers(nodes: DataFrame, most: int, arity: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each tier of superblocks, and one root (tree, digest) for each tree; ``most`` nodes are in the largest tree."""
    tiers, roots = [nodes], None
    while True:
        up = tx.written(_up(tiers[-1], arity, levels), name)
        done = up.filter("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        most = -(-most // arity**levels)
        if most <= 1:
            return tiers, roots
        tiers.append(up.filter("n > 1"))


def _outer(tiers: list[DataFrame], first: DataFrame, arity: int, levels: int, name: str) -> DataFrame:
    """Outer nodes for the lowest superblocks; ``first`` has them for the highest superblock of each tree."""
    width = arity**levels
    outer = first.limit(0)
    for k in range(len(tiers) - 1, -1, -1):
        # trees whose highest superblock is here
        tops = tiers[k].filter((F.col("n") <= width) & (F.col("pos") == 0)).select("tree")
        outer = outer.unionByName(first.join(tops, "tree", "left_semi"))
        if k:
            outer = tx.written(_down(tiers[k], outer, arity, levels), name)
    return outer


def manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None, proofs: bool = True, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """For each row its leaf, its source's root, the root, its proof's digest and the root that its proof folds to.

    Where ``tampered`` holds, the leaf that is folded is made with ``tampered_text`` as the text. With ``proofs`` the column
    ``proof`` has the siblings themselves, level by level from the leaf to the root, left to right.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = F.lit(None).cast("string")
    if tampered is not None:
        other = leaf_digest([*fields[:-1], tampered_text])
        # the digest is made where the text differs only
        changed = F.when(tampered & ~tampered_text.eqNullSafe(F.col("text")), other)
    leaves = tx.written(docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), changed.alias("changed")), "leaves")
    placed = tx.written(ranks.numbered(leaves, ["source", "doc_id", "leaf"], "number"), "numbered")
    sources = tx.written(placed.groupBy("source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "sources")
    known = ranks.numbered(sources, ["source"], "tree").select(F.col("source").alias("of"), "tree", "first", "n")
    known = tx.written(known, "trees")
    n_sources, most = known.agg(F.count(F.lit(1)), F.max("n")).first()
    hint = F.broadcast(known) if n_sources <= BROADCAST_SOURCES else known
    nodes = placed.join(hint, F.col("source").eqNullSafe(F.col("of"))).select("tree", (F.col("number") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", "changed")
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * proofs
    if not n_sources:
        return docs.sparkSession.createDataFrame([], out)
    nodes = tx.written(nodes, "nodes")
    tiers, subroots = _tiers(nodes.select("tree", "pos", "n", "digest"), most, arity, levels, "superblocks")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest")
    top_tiers, roots = _tiers(top, n_sources, arity, levels, "top-superblocks")
    empty = F.array().cast("array<string>")
    highest = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("block"), empty.alias("up"), empty.alias("down"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    below = _down(top, _outer(top_tiers, highest, arity, levels, "top-outer"), arity, levels)
    by_source = below.select((F.col("block") + 1).alias("tree"), F.lit(0).cast("long").alias("block"), "up", "down", "root")
    by_source = tx.written(by_source.join(subroots.withColumnRenamed("digest", "subroot"), "tree").select("tree", "block", "up", "down", "subroot", "root"), "source-outer")
    outer = _outer(tiers, by_source, arity, levels, "outer")

    def folded(key: tuple, block: pd.DataFrame, outs: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        o = outs.iloc[0]
        nodes, up, down = block["digest"].tolist(), list(o["up"]), list(o["down"])
        rows: dict[str, list] = {c: [] for c in ("proof_sha256", "folded_root", "proof")}
        for node, changed, (a, b) in zip(nodes, block["changed"], _paths(_levels(nodes, int(block["n"].iloc[0]), arity, levels), arity), strict=True):
            left, right = a + up, b + down
            siblings = [x for pair in zip(left, right, strict=True) for x in pair]
            rows["proof_sha256"].append(digest(siblings))
            rows["folded_root"].append(fold(changed if isinstance(changed, str) else node, left, right))
            if proofs:
                rows["proof"].append([s[i : i + 64] for s in siblings for i in range(0, len(s), 64)])
        if not proofs:
            del rows["proof"]
        found = pd.DataFrame({"doc_id": block["doc_id"].astype("Int64").array, "leaf": nodes, "subroot": o["subroot"], "root": o["root"], **rows})
        return found.assign(verified=found["folded_root"] == found["root"])

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / arity**levels).cast("long"))
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(folded, out)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Where 2 divides the CRC-32 of the decimal doc_id, line ends have been deleted from the text; null texts and rows of null doc_id are as they were."""
    with tx.scratch():
        made = manifest(
            tx.table(spark, sf_dir, "documents"),
            tampered=F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)),
            tampered_text=F.replace("text", F.lit("\n"), F.lit("")),
            proofs=False,
        )
        return tx.written(made, "manifest", keep=True)


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
d AS (SELECT doc_id, source, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS e, text AS x FROM documents),
f AS (SELECT doc_id, source, concat(CASE WHEN a IS NULL THEN '-' ELSE concat(strlen(a), ':', a) END, CASE WHEN b IS NULL THEN '-' ELSE concat(strlen(b), ':', b) END, CASE WHEN c IS NULL THEN '-' ELSE concat(strlen(c), ':', c) END, CASE WHEN e IS NULL THEN '-' ELSE concat(strlen(e), ':', e) END) AS head, x, replace(x, chr(10), '') AS y,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(a, ''), lambda z: ascii(z)::BIGINT)), lambda c, z: xor(c >> 8, crc.t[(xor(c, z) & 255) + 1]))) % 2 = 0 AS tampered FROM d, crc),
l AS (SELECT doc_id, source, sha256(concat(head, CASE WHEN x IS NULL THEN '-' ELSE concat(strlen(x), ':', x) END)) AS leaf, sha256(concat(head, CASE WHEN x IS NULL THEN '-' WHEN tampered THEN concat(strlen(y), ':', y) ELSE concat(strlen(x), ':', x) END)) AS used FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
s AS (SELECT source, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL SELECT source, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM s WHERE n > 1 GROUP BY source, lvl, pos // 3),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s WHERE n = 1),
r AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM sub
  UNION ALL SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY lvl, pos // 3),
ss AS (SELECT source, lvl, pos, n, coalesce(string_agg(h, '') OVER (PARTITION BY source, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY source, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM s),
rs AS (SELECT lvl, pos, n, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM r),
g AS (SELECT doc_id, source, leaf, pos AS at, 0 AS lvl, pos, used AS h, '' AS proof, n FROM p
  UNION ALL SELECT g.doc_id, g.source, g.leaf, g.at, g.lvl + 1, g.pos // 3, sha256(ss.a || g.h || ss.b), g.proof || ss.a || ss.b, (g.n + 2) // 3 FROM g JOIN ss ON g.source IS NOT DISTINCT FROM ss.source AND g.lvl = ss.lvl AND g.pos = ss.pos WHERE g.n > 1),
t AS (SELECT g.doc_id, g.source, g.at, g.leaf, sub.subroot, 0 AS lvl, sub.pos, g.h, g.proof, sub.n FROM g JOIN sub ON g.source IS NOT DISTINCT FROM sub.source WHERE g.n = 1
  UNION ALL SELECT t.doc_id, t.source, t.at, t.leaf, t.subroot, t.lvl + 1, t.pos // 3, sha256(rs.a || t.h || rs.b), t.proof || rs.a || rs.b, (t.n + 2) // 3 FROM t JOIN rs ON t.lvl = rs.lvl AND t.pos = rs.pos WHERE t.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM t, (SELECT h AS root FROM r WHERE n = 1) WHERE n = 1
"""
