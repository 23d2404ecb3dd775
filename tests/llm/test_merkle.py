"""Merkle proofs against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest

from tradeframe.llm.merkle import document_proofs

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, place int, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """The top, and for each node its levels of (before, behind)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            proofs[i].append((run[: k % 16], run[k % 16 + 1 :]))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], proofs


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for r, own in zip(by[s], trees[s][1]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], lowered(r[4]))) if changed else leaf(r)
            for left, right in own + top:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), trees[s][0], root, h(*(x for left, right in own + top for x in left + right)), node, node == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "l") for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 17, "b": 1}, {"hot": 700, "é": 256, "z": 257, None: 2, "": 3}])
def test_proofs(spark, sizes):
    draw = random.Random(1)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "lower", "Größe ABC", "Xy" * draw.randint(1, 50)])
            rows.append((draw.choice([None, draw.randint(-9, 500), draw.choice([-(2**63), 2**63 - 1])]), s, draw.choice([None, "de"]), None if text is None else len(text), text))
    rows += rows[:3]
    got = [tuple(r) for r in document_proofs(table(spark, rows)).collect()]
    key = lambda t: tuple((x is not None, x) if x is not None else (False, 0) for x in t)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert len({t[6] for t in got}) == 2 or len(rows) < 9


def test_many_sources_and_a_very_long_text(spark):
    rows = [(i, f"s{i % 300}", "en", 1, "T" * (200_000 if i == 5 else 1)) for i in range(620)]
    got = [tuple(r) for r in document_proofs(table(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_empty(spark):
    assert document_proofs(table(spark, [(1, "a", "b", 1, "c")]).limit(0)).collect() == []
