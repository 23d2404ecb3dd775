"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import Saved

#: Links that a task takes at once. A graph of no more is one task's work; a larger one goes through rounds.
AT_ONCE = 1 << 17


def _stars(links: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """Each node of the links that a task takes at once, hung on the least node that they lead to; with `roots` that one on
    itself too. Components stay the same."""

    def stars(found: dict[int, int]) -> pa.RecordBatch:
        rows = []
        for node in found:
            root = node
            while found[root] != root:
                root = found[root]
            found[node] = root
            if roots or node != root:
                rows.append((node, root))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, taken = {}, 0
        for batch in batches:
            for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if taken == most:
                    yield stars(found)
                    found, taken = {}, 0
                taken += 1
                ends = []
                for x in (a, b):
                    while (up := found.setdefault(x, x)) != x:
                        found[x] = x = found[up]
                    ends.append(x)
                found[max(ends)] = min(ends)
        if found:
            yield stars(found)

    return links.mapInArrow(run, "hi bigint, lo bigint")


def components(links: DataFrame, most: int = AT_ONCE) -> Saved:
    """(node, component) for each node of links (a, b), both long: component is the least node reachable.

    Each task first makes stars of its own links, `most` at a time. If no more than `most` links are left, they are once more
    one task's, else there are rounds of large-star and small-star steps: each node's neighbours are hung on the least of
    them, first the larger ones, then the others. Each round is two groupings, shrinks the paths by half or more, and ends in
    a written table. Null ends and links of a node to itself are left out; repeated links count once; without links there are
    no rows."""
    near = Saved(_stars(links.where("a <> b").select("a", "b"), max(most, 1)), "links")
    if near.df.count() <= most:
        out = Saved(_stars(near.df.coalesce(1), max(most, 1), roots=True).select(F.col("hi").alias("node"), F.col("lo").alias("component")), "components")
        near.drop()
        return out
    edges = Saved(near.df.distinct(), "links")
    near.drop()
    while True:
        both = edges.df.union(edges.df.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).withColumn("m", F.least("m", "node"))
        large = edges.df.join(least, edges.df.lo == least.node).select("hi", F.col("m").alias("lo")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        new = Saved(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        # done when each node hangs on a node that itself hangs on none
        hung = new.df.select(F.col("hi").alias("node"))
        again = new.df.join(hung, new.df.lo == hung.node, "left_semi").limit(1).count()
        many = 0 if again else new.df.groupBy("hi").count().where("count > 1").limit(1).count()
        edges.drop()
        edges = new
        if not again and not many:
            break
    nodes = edges.df.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    out = Saved(nodes.union(edges.df.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()), "components")
    edges.drop()
    return out
