"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import text as tx


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest reachable node.

    A step joins each node only with the minimum of its neighbours, so no step makes more rows than
    the edges it reads, and hubs are folded by an aggregation with partial sums. Each round is
    written to the shared folder. Edges from a node to itself and repeated edges are harmless.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    cur = tx.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: each neighbour v > u goes to the least neighbour of u
        arcs = cur.select(F.explode(both).alias("e")).select("e.u", "e.v")
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = arcs.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        cur = tx.written(small, "edges")
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components still change after {max_rounds} rounds")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(cur.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
