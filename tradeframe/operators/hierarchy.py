"""Clusters merged from the bottom up, and labels of two clusterings matched one to one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ward_merges(centres: np.ndarray, weights: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of the merges of weighted points that least raise the sum of squares, ascending; a and b are any points
    of the two parts. A chain goes from neighbour to nearest neighbour until two are each other's: no table of all distances."""
    centres, weights = centres.astype(float).copy(), weights.astype(float).copy()
    alive, chain, out = np.ones(len(weights), bool), [], []
    for _ in range(len(weights) - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            at = chain[-1]
            rise = weights * weights[at] / (weights + weights[at]) * ((centres - centres[at]) ** 2).sum(1)
            rise[~alive] = np.inf
            rise[at] = np.inf
            near = int(np.argmin(rise))
            if len(chain) > 1 and rise[chain[-2]] <= rise[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        out.append((2 * float(rise[near]), at, near))
        whole = weights[at] + weights[near]
        centres[near] = (weights[at] * centres[at] + weights[near] * centres[near]) / whole
        weights[near], alive[at] = whole, False
    return sorted(out)


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> list[int]:
    """Labels of n points where all but the last k - 1 merges are made; the label of the first point's part is 0, and so on."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, a, b in merges[: max(n - k, 0)]:
        up[top(a)] = top(b)
    names: dict[int, int] = {}
    return [names.setdefault(top(i), len(names)) for i in range(n)]


def hierarchical_labels(df: DataFrame, k: int, cells: int = 1024, seed: int = 42) -> DataFrame:
    """Add cluster to rows with `scaled`: Ward's hierarchy, cut at k clusters.

    Rows are gathered in at most `cells` cells by MLlib's k-means first. Only the cells' means and counts, a table of that
    bounded size, come to the driver and are merged upwards; each row has its cell's cluster. With cells as many as distinct
    rows it is Ward's method itself. Labels run from 0 in the order of the cells."""
    model = KMeans(k=cells, seed=seed, featuresCol="scaled", predictionCol="__cell").fit(df)
    found = model.transform(df)
    size = len(model.clusterCenters()[0])
    means = found.select("__cell", vector_to_array("scaled").alias("v")).groupBy("__cell").agg(F.count("*").alias("n"), F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(size))).alias("mean"))
    rows = means.orderBy("__cell").collect()
    labels = cut(ward_merges(np.array([r.mean for r in rows]), np.array([r.n for r in rows])), len(rows), k)
    table = df.sparkSession.createDataFrame([(r["__cell"], label) for r, label in zip(rows, labels)], "__cell int, cluster int")
    return found.join(F.broadcast(table), "__cell").drop("__cell")


def matched(counts: np.ndarray) -> list[int]:
    """For each row of a table the column that it is matched with, one to one, so that the matched cells' sum is greatest;
    rows beyond the columns have -1. Each row is put in along the cheapest path of exchanges."""
    n, m = counts.shape
    if n > m:
        back = matched(counts.T)
        return [back.index(i) if i in back else -1 for i in range(n)]
    cost = counts.max(initial=0) - counts.astype(float)
    u, v, row_of = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m] = i
        at, least, from_, seen = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[at] >= 0:
            seen[at] = True
            r = row_of[at]
            slack = cost[r] - u[r] - v[:m]
            better = ~seen[:m] & (slack < least)
            least[better], from_[better] = slack[better], at
            open_ = np.where(seen[:m], np.inf, least)
            nxt = int(np.argmin(open_))
            step = open_[nxt]
            taken = np.flatnonzero(seen)
            u[row_of[taken]] += step
            v[taken] -= step
            least[~seen[:m]] -= step
            at = nxt
        while at != m:
            row_of[at] = row_of[from_[at]]
            at = from_[at]
    out = [-1] * n
    for j in range(m):
        if row_of[j] >= 0:
            out[row_of[j]] = j
    return out


def cluster_stability(df: DataFrame, fit: Callable[[DataFrame, int], Model], rounds: int = 5, seed: int = 42) -> DataFrame:
    """(round, first, matched, n, kept, agreement): for each cluster of the first fit, the cluster of a fit to a resample that
    it is matched with, its rows, how many of them that one has, and the share of all rows that have the matched label.

    Labels are matched one to one, so two clusters that a resample merges don't both agree with it. A resample draws rows
    with replacement by seed; each round runs over the whole frame, and a table of a row for each pair of labels is matched."""
    first = fit(df, seed).transform(df).select("scaled", F.col("cluster").alias("first"))
    out = []
    for i in range(rounds):
        model = fit(df.sample(True, 1.0, seed + i + 1), seed)
        pairs = {(r["first"], r["cluster"]): r["n"] for r in model.transform(first).groupBy("first", "cluster").agg(F.count("*").alias("n")).collect()}
        a, b = sorted({x for x, _ in pairs}), sorted({y for _, y in pairs})
        table = np.array([[pairs.get((x, y), 0) for y in b] for x in a]).reshape(len(a), len(b))
        to, n = matched(table), int(table.sum())
        kept = [int(table[x, y]) if y >= 0 else 0 for x, y in enumerate(to)]
        out += [(i, int(a[x]), int(b[y]) if y >= 0 else None, int(table[x].sum()), kept[x], sum(kept) / n) for x, y in enumerate(to)]
    return df.sparkSession.createDataFrame(out, "round int, first int, matched int, n long, kept long, agreement double")
