"""Components of links: one task's work where they are few, rounds where they are many, the same rows either way."""

import random

import pytest

from tradeframe.llm.components import AT_ONCE, components


def links_of(spark, links):
    return spark.createDataFrame(links, "a bigint, b bigint").repartition(3)


@pytest.mark.parametrize("most", [0, 7, AT_ONCE])
def test_at_any_size(spark, most):
    draw = random.Random(3)
    links = [(draw.randrange(-90, 90), draw.randrange(-90, 90)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1030)] + [(5, None), (2000, 2000), (1000, 1001)]
    label = {x: x for a, b in links if b is not None and a != b for x in (a, b)}
    for _ in label:
        for a, b in links:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in components(links_of(spark, links), most).df.collect()} == label
    assert components(links_of(spark, [(1, 1)]), most).df.count() == 0


def test_few_links_are_not_dealt(spark):
    """Each round of a graph as long as a chain of links dealt all shuffle partitions some ten times."""
    links = links_of(spark, [(i, i + 1) for i in range(60)])
    spark.sparkContext.setJobGroup("components", "components")
    try:
        components(links)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8
