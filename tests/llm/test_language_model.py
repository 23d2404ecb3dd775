"""The automaton against a backoff model counted word by word, and its probabilities' sums."""

import math
import random
import zlib
from collections import Counter

import pytest

from tradeframe.llm import lm_score
from tradeframe.llm.lm_score import lm_scores


def chain(seed):
    draw, out = random.Random(seed), [0]
    for _ in range(draw.randrange(60)):
        out.append((out[-1] * 3 + 1) % 17 if draw.random() < 0.8 else draw.randrange(41))
    return " ".join(f"w{x}" for x in out)


def brute(rows, order=3, lean=lm_score.LEAN):
    """The model as a function (context, word) -> probability, and its known words."""
    counts = [Counter() for _ in range(order)]
    token = lambda t: (t or "").encode().lower().split() + [b"\n"]
    n_texts = 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            n_texts += 1
            line = [b" ", *token(t)]
            for k in range(1, len(line)):
                for n in range(order):
                    if k - n >= 0:
                        counts[n][tuple(line[k - n : k + 1])] += 1
    tokens, words = sum(counts[0].values()), len(counts[0])

    def p(context, word):
        out = (counts[0][(word,)] + 1) / (tokens + words + 1)
        for n in range(1, min(order, len(context) + 1)):
            before = tuple(context[-n:])
            seen = n_texts if before == (b" ",) else counts[n - 1][before]
            out = (counts[n][(*before, word)] + lean * out) / (seen + lean)
        return out

    return p, [w for (w,) in counts[0]], token


@pytest.mark.parametrize("sizes", [{}, {"most": 300, "range_bytes": 4_000}])
def test_scores_equal_brute_force(spark, sizes):
    rows = [(i, chain(i)) for i in range(150)] + [(500, None), (501, ""), (502, "never seen"), (None, "w1 w4"), (3, chain(3)), (3, "W1  w4"), (503, "w1 w4 " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string").repartition(3).cache()
    docs.count()
    p, words, token = brute(rows)
    got = lm_scores(docs, **sizes).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        line = [b" ", *token(t)]
        total = sum(math.log10(p(line[max(0, k - 2) : k], line[k])) for k in range(1, len(line)))
        base = sum(math.log10(p([], w)) for w in line[1:])
        want.append((i is None, i or 0, len(line) - 1, sum(w in set(words) for w in line[1:]), base, total))
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    rows = [(i, chain(i)) for i in range(60)]
    p, words, _ = brute(rows)
    for context in ([], [b" "], [b"w1"], [b" ", b"w0"], [b"w1", b"w4"], [b"w1", b"none"]):
        assert sum(p(context, w) for w in [*words, b"unseen"]) == pytest.approx(1)
