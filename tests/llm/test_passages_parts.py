"""Passages of one source that lie near each other, with unlike words between."""

import pytest

from tradeframe.llm.passages import repeated_passages


def some(n, name):
    return [f"{name}{i}" for i in range(n)]


@pytest.mark.parametrize("first,gap,second", [(50, 30, 50), (60, 30, 24), (24, 30, 60)])
def test_parts(spark, first, gap, second):
    a, b = some(first, "a"), some(second, "b")
    texts = [some(20, "p") + a + some(gap, "q") + b + some(20, "r"), some(35, "s") + a + some(gap, "t") + b + some(20, "u")]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted((r.first_word, r.end_word, r.source_first, r.source_end) for r in repeated_passages(docs).collect())
    at = [(0, first), (first + gap, first + gap + second)]
    assert got == [(35 + i, 35 + j, 20 + i, 20 + j) for i, j in at if j - i >= 50]
