"""Samples ordered by how alike they are: correlations over filtered, centred ratios, and a hierarchical clustering of them.

Ratios stay in Spark; the samples x samples matrix of correlations is what reaches the driver, and the clustering needs no more than that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import links
from . import results


@dataclass(frozen=True)
class Tree:
    """Merges in the order of their heights: two clusters each (samples first, then merges from the first on), heights, and the leaves from left to right."""

    merges: list[tuple[int, int]]
    heights: list[float]
    order: list[int]


def complete_linkage(distance: np.ndarray) -> Tree:
    """Hierarchical clustering by the largest distance between members, by chains of nearest neighbours: time and memory are the square of the number of samples.

    At each merge the tighter cluster, that of the lower last merge, stands left; two samples stand in their order.
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            # on ties back to where the chain came from, or it would not end
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        height = d[a, b]
        chain = chain[:-2]
        keep, gone = min(a, b), max(a, b)
        found.append((float(height), keep, gone))
        d[keep] = d[:, keep] = np.maximum(d[keep], d[gone])
        d[keep, keep] = np.inf
        alive[gone] = False
    # merges in the order of their heights; a cluster is known by its smallest sample
    at = list(range(n))
    merges, heights, leaves = [], [], [[i] for i in range(n)]
    for height, a, b in sorted(found, key=lambda m: m[0]):
        x, y = sorted((at[a], at[b]))  # the sample or the earlier merge first: it is the tighter one
        merges.append((x, y))
        heights.append(height)
        leaves.append(leaves[x] + leaves[y])
        at[a] = at[b] = n + len(merges) - 1
    return Tree(merges, heights, leaves[-1] if n else [])


def cut(tree: Tree, k: int, n: int) -> list[int]:
    """The cluster of each sample, from 1, when k clusters are left; they are numbered in the order of their first samples."""
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    for m, (x, y) in enumerate(tree.merges[: max(n - k, 0)]):
        members[n + m] = members.pop(x) + members.pop(y)
    out = [0] * n
    for number, own in enumerate(sorted(members.values(), key=min), 1):
        for i in own:
            out[i] = number
    return out


def centred(cells: DataFrame, min_median: float = 1, min_count: int = 10, logit: bool = False, pseudocount: float = 0.1, normalised: bool = False) -> DataFrame:
    """junction_id, sample_id and x: ratios (or their capped logits) less the mean of their junction, and with ``normalised`` less the centred prediction.

    Junctions have a median count of ``min_median`` and a largest one of ``min_count`` at least; cells of fewer than ``min_count`` reads in all have no x, and samples with fewer than two junctions above that go.
    """
    row, sample = Window.partitionBy("junction_id"), Window.partitionBy("sample_id")
    kept = cells.withColumns({"_median": F.median("k").over(row), "_max": F.max("k").over(row)}).filter((F.col("_median") >= min_median) & (F.col("_max") >= min_count))
    kept = kept.withColumn("_covered", F.count_if(F.col("n") > min_count).over(sample)).filter("_covered >= 2")
    ratio = (F.col("k") + pseudocount) / (F.col("n") + 2 * pseudocount)
    known = F.col("n") >= min_count
    value = lambda c: links.capped_logit(c) if logit else F.col(c)
    kept = kept.withColumn("_r", ratio).withColumn("x", F.when(known, value("_r"))).withColumn("x", F.col("x") - F.avg("x").over(row))
    if normalised:
        kept = kept.withColumn("_p", F.when(known, value("mu"))).withColumn("x", F.col("x") - (F.col("_p") - F.avg("_p").over(row)))
    return kept.select("junction_id", "sample_id", "x")


def ordered_correlation(cells: DataFrame, n_clusters: int = 5, **filters) -> DataFrame:
    """a, b, spearman, and the places and clusters of both samples in the order of the clustering, for every pair of samples, both ways and with themselves.

    Samples are clustered by the Euclidean distances of their rows of correlations; a missing correlation counts as 0 there and stays NULL.
    """
    spark = cells.sparkSession
    pairs = results.sample_correlation(centred(cells, **filters), "x").collect()  # samples squared
    names = sorted({s for r in pairs for s in (r.a, r.b)})
    place = {s: i for i, s in enumerate(names)}
    m = np.eye(len(names))
    for r in pairs:
        m[place[r.a], place[r.b]] = m[place[r.b], place[r.a]] = np.nan if r.spearman is None else r.spearman
    known = np.nan_to_num(m)
    square = (known**2).sum(axis=1)
    tree = complete_linkage(np.sqrt(np.maximum(square[:, None] + square[None] - 2 * known @ known.T, 0)))
    clusters = cut(tree, n_clusters, len(names))
    at = {leaf: i for i, leaf in enumerate(tree.order)}
    rows = [(a, b, None if np.isnan(m[i, j]) else float(m[i, j]), at[i], at[j], clusters[i], clusters[j]) for i, a in enumerate(names) for j, b in enumerate(names)]
    kind = cells.schema["sample_id"].dataType.simpleString()
    return spark.createDataFrame(rows, f"a {kind}, b {kind}, spearman double, place_a int, place_b int, cluster_a int, cluster_b int")
