"""Bottom-up clusters and matched labels against plain search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tradeframe.operators.clusters import fit_kmeans
from tradeframe.operators.hierarchy import cluster_stability, cut, hierarchical_labels, matched, ward_merges


def plain_ward(x, w, k):
    """Labels by looking at all pairs before each merge."""
    parts = [[i] for i in range(len(w))]
    mean = lambda p: np.average(x[p], axis=0, weights=w[p])
    while len(parts) > k:
        rise = lambda a, b: w[a].sum() * w[b].sum() / (w[a].sum() + w[b].sum()) * ((mean(a) - mean(b)) ** 2).sum()
        a, b = min(itertools.combinations(range(len(parts)), 2), key=lambda p: rise(parts[p[0]], parts[p[1]]))
        parts[a] += parts.pop(b)
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("seed", range(6))
def test_ward_equals_all_pairs(seed):
    draw = np.random.default_rng(seed)
    x, w = draw.normal(size=(40, 3)), draw.integers(1, 9, 40).astype(float)
    merges = ward_merges(x, w)
    for k in (1, 2, 5, 40):
        labels = cut(merges, 40, k)
        assert {frozenset(np.flatnonzero(np.array(labels) == c)) for c in set(labels)} == plain_ward(x, w, k)
        assert len(set(labels)) == k


@pytest.mark.parametrize("seed", range(8))
def test_matching_is_the_best(seed):
    draw = np.random.default_rng(seed)
    table = draw.integers(0, 30, (draw.integers(1, 6), draw.integers(1, 6)))
    to = matched(table)
    got = sum(table[i, j] for i, j in enumerate(to) if j >= 0)
    n, m = table.shape
    best = max(sum(table[i, j] for i, j in zip(rows, columns)) for rows in itertools.permutations(range(n), min(n, m)) for columns in itertools.combinations(range(m), min(n, m)))
    assert got == best and len({j for j in to if j >= 0}) == min(n, m)


@pytest.fixture(scope="module")
def blobs(spark):
    """Two near pairs of groups, of unlike sizes, and one far off."""
    draw = random.Random(2)
    centres = {0: (0, 0, 300), 1: (3, 0, 60), 2: (20, 20, 300), 3: (23, 20, 90), 4: (-40, 5, 50)}
    rows = [(g, [x + draw.gauss(0, 0.3), y + draw.gauss(0, 0.3)]) for g, (x, y, n) in centres.items() for _ in range(n)]
    return spark.createDataFrame(rows, "g int, v array<double>").withColumn("scaled", array_to_vector("v")).drop("v")


@pytest.mark.parametrize("k, parts", [(5, {0, 1, 2, 3, 4}), (3, None)])
def test_hierarchy_of_blobs(blobs, k, parts):
    """At five clusters each group is one; at three, near groups are together."""
    rows = hierarchical_labels(blobs, k, cells=64).select("g", "cluster").distinct().collect()
    assert len(rows) == 5
    of = {r.g: r.cluster for r in rows}
    assert len(set(of.values())) == k
    if k == 3:
        assert of[0] == of[1] and of[2] == of[3]


def test_stability(blobs):
    rows = cluster_stability(blobs, lambda df, seed: fit_kmeans(df, 3, seed), 3).collect()
    assert {r["round"] for r in rows} == {0, 1, 2} and all(r.agreement == 1.0 and r.kept == r.n for r in rows)
    assert all(len({r.matched for r in rows if r["round"] == i}) == 3 for i in range(3))
