"""The clustering of samples against a plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators import clusters
from junctura.sources.cohort import jaccard_cells


def plain(d):
    """Merges of the closest pair of clusters, one after another."""
    groups, out = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        pairs = [(max(d[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        height, x, y = min(pairs)
        out.append((height, sorted(groups[x] + groups[y])))
        groups = [g for i, g in enumerate(groups) if i not in (x, y)] + [groups[x] + groups[y]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_merges_are_those_of_the_closest_clusters(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 14))
    x = rng.normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    tree = clusters.complete_linkage(d)
    members = {i: [i] for i in range(n)}
    for i, (a, b) in enumerate(tree.merges):
        members[n + i] = sorted(members[a] + members[b])
    want = plain(d)
    assert np.allclose(tree.heights, [h for h, _ in want]) and [members[n + i] for i in range(len(want))] == [m for _, m in want]
    assert sorted(tree.order) == list(range(n))
    # every cluster stands together, the tighter part left
    for own in members.values():
        at = sorted(tree.order.index(i) for i in own)
        assert at == list(range(at[0], at[0] + len(own)))
    for k in range(1, n + 1):
        cut = clusters.cut(tree, k, n)
        assert len(set(cut)) == k and cut[0] == 1 and all(c <= max(cut[:i]) + 1 for i, c in enumerate(cut) if i)


def test_equal_distances_end():
    tree = clusters.complete_linkage(np.ones((5, 5)) - np.eye(5))
    assert tree.heights == [1.0] * 4 and sorted(tree.order) == [0, 1, 2, 3, 4] and clusters.cut(tree, 9, 5) == [1, 2, 3, 4, 5]


def test_tighter_clusters_stand_left():
    d = np.abs(np.subtract.outer([0.0, 10, 1, 13, 30], [0.0, 10, 1, 13, 30]))
    assert clusters.complete_linkage(d).order == [4, 0, 2, 1, 3]


@pytest.mark.parametrize("logit", [False, True])
def test_ordered_correlations(spark, sf_dir, logit):
    cells = jaccard_cells(spark, sf_dir).withColumnRenamed("n_jaccard", "n").withColumn("mu", F.lit(0.3))
    got = clusters.ordered_correlation(cells, 3, min_median=0, min_count=2, logit=logit, normalised=True).collect()
    n = int(len(got) ** 0.5)
    assert n * n == len(got) and {r.place_a for r in got} == set(range(n)) and {r.cluster_a for r in got} == {1, 2, 3}
    at = {(r.a, r.b): r for r in got}
    assert all(at[b, a].spearman == r.spearman for (a, b), r in at.items()) and all(r.spearman == 1 for (a, b), r in at.items() if a == b)
    few = clusters.centred(cells, min_median=0, min_count=2)
    assert few.groupBy("junction_id").agg(F.abs(F.sum("x")).alias("s")).filter("s > 1e-9").isEmpty()
