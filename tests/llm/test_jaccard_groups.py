"""Sketches leave no similar pair out, and the group steps give the same rows at any size that parts them."""

import random
from fractions import Fraction

import numpy as np
import pytest

from tradeframe.llm import ngram_jaccard
from tradeframe.llm.ngram_jaccard import jaccard_components, parity_sketch, sketches_within


def test_sketches_bound_what_is_apart():
    draw = np.random.default_rng(1)
    for _ in range(40):
        pool = draw.integers(0, 2**63, 400, dtype=np.uint64)
        sets = [np.unique(draw.choice(pool, draw.integers(1, 390))) for _ in range(12)]
        sets += [np.unique(np.concatenate([s[draw.random(len(s)) < 0.95], pool[:2]])) for s in sets]
        component = draw.integers(0, 6, len(sets))
        t = Fraction(8, 10)
        got = set(zip(*(x.tolist() for x in sketches_within(np.array([len(s) for s in sets]), [parity_sketch(s) for s in sets], component, t))))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if component[i] != component[j] and both >= t * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in got
        assert len(got) < len(sets) ** 2 / 4


@pytest.mark.parametrize("paired, rounds", [(64, 4), (3, 0), (3, 2), (0, 0)])
def test_same_components(spark, monkeypatch, paired, rounds):
    draw = random.Random(7)
    base = [f"w{draw.randrange(4000)}" for _ in range(300)]
    texts = []
    for k in range(60):
        t = list(base if k % 3 else texts[-1] if texts else base)
        for _ in range(draw.randint(0, 14)):
            t[draw.randrange(len(t))] = f"n{draw.randrange(10**6)}"
        texts.append(t)
    texts += [[f"x{k}", *base[:20]] for k in range(30)] + [base[:3]] * 2 + [["very"] + base * 20, ["very", "long"] + base * 20]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        new = list(label)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 10 * len(a & b) >= 8 * len(a | b):
                    new[i] = min(new[i], label[j])
        if new == label:
            break
        label = new
    monkeypatch.setattr(ngram_jaccard, "PAIRED", paired)
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", rounds)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 5, Fraction(8, 10)).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_few_links_join_no_groups_anew(spark, monkeypatch):
    """A round of new centres that finds few links doesn't join all open rows with their groups once more, and loses nothing."""
    draw = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(50):
        t = list(base)
        for _ in range(draw.randint(2, 9)):
            t[draw.randrange(len(t))] = f"n{draw.randrange(10**6)}"
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(sets)))
    while (new := [min(label[j] for j, b in enumerate(sets) if 10 * len(a & b) >= 8 * len(a | b)) for a in sets]) != label:
        label = new
    opened, joined = [], []
    once, join = ngram_jaccard._open, ngram_jaccard._joined
    monkeypatch.setattr(ngram_jaccard, "_open", lambda *x: opened.append(1) or once(*x))
    monkeypatch.setattr(ngram_jaccard, "_joined", lambda *x: joined.append(1) or join(*x))
    monkeypatch.setattr(ngram_jaccard, "PAIRED", 3)
    monkeypatch.setattr(ngram_jaccard, "WORTH", 0)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 5, Fraction(8, 10)).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert joined and len(opened) == 1
