"""Toxicity with more labels of each kind than the sample of examples has room for."""

import random

import numpy as np
import pytest

from tradeframe.llm import toxicity as module
from tradeframe.llm.toxicity import Examples, fit, toxicity


def test_many_toxic_labels(spark):
    draw = random.Random(11)
    text = lambda i: " ".join(f"w{draw.randrange(3000)}" for _ in range(12)) + draw.choice([" vile", " rotten"]) * (i % 2)
    n = 9_000
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    for held_out in (0, None):
        got = toxicity(docs, labels, held_out=held_out).toPandas()
        toxic = got["doc_id"] % 2 == 1
        assert len(got) == n and got["predicted"][toxic].mean() > 0.99 and got["predicted"][~toxic].mean() < 0.01


def test_nearest_equals_brute_force(monkeypatch):
    draw = np.random.default_rng(3)
    dense = np.where(draw.random((700, 30)) < 0.2, draw.integers(1, 4, (700, 30)), 0).astype(float)
    dense = dense[dense.any(axis=1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows, terms = np.nonzero(dense)
    model = Examples(np.arange(30, dtype=np.uint64), np.ones(30), 0.5)
    model.build(list(range(len(dense))), np.zeros(len(dense)), rows, terms, dense[rows, terms])
    for few in (0, 2, 10**6):
        monkeypatch.setattr(module, "FEW", few)
        for q in dense[:60]:
            at = np.flatnonzero(q)
            cosine = [sum(float(q[t]) * float(e[t]) for t in at) for e in dense]
            want = sorted(((c, i) for i, c in enumerate(cosine) if c > 0), key=lambda x: (-x[0], x[1]))[:15]
            assert [c for c, _ in model.nearest(at, q[at], 15)] == pytest.approx([c for c, _ in want], abs=1e-11)


@pytest.mark.parametrize("most", [60, 300, 10_000])
def test_fewer_places_than_labels(spark, most):
    draw = random.Random(5)
    text = lambda i: " ".join(f"w{draw.randrange(400)}" for _ in range(30)) + draw.choice([" vile", " rotten", " foul"]) * (i % 10 == 0)
    n = 2_000
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id bigint, text string")
    for share in (10, 2):
        labels = docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 as int) as toxic").where(f"toxic = 1 or doc_id % {share} = 1")
        rows = docs.selectExpr("doc_id as id", "text")
        model = fit(rows, labels.selectExpr("doc_id as id", "toxic as label"), most, most_examples=min(most, 200))
        assert len(model.terms) and 0 < len(model.ids) <= min(most, 200)
        got = module.score(rows, model).toPandas()
        toxic = got["id"] % 10 == 0
        assert (got["score"][toxic] >= 0.5).mean() > 0.95 and (got["score"][~toxic] >= 0.5).mean() < 0.05


def test_edges(spark):
    long = "word " * 200_000 + "vile"
    rows = [(i, ("vile " if i % 4 == 0 else "mild ") + f"w{i % 7}", "a") for i in range(80)]
    rows += [(200, long, "b"), (200, long, "b"), (201, None, None), (202, "", None), (None, "vile", "c"), (0, "another text of id 0", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(80)] + [(0, 0, "y"), (5, 7, None), (None, 1, None)], "doc_id bigint, toxic int, text string")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    twice = [r.score for r in got if r.doc_id == 200]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    only = toxicity(docs, labels.where("toxic = 1")).collect()
    assert len(only) == len(rows) and all(r.score >= 0.5 for r in only)
