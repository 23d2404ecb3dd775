"""Fingerprints worked out again in plain Python, and neighbours of ids that are far apart, clustered, null and repeated."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from tradeframe.llm.fingerprints import BINS, WIDTH, fingerprints


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return []
    if len(words) < WIDTH:
        return [signed(xxhash.xxh64(" ".join(map(str, words)).encode(), seed=42).intdigest())]
    out = []
    for i in range(len(words) - WIDTH + 1):
        seed = 42
        for w in words[i : i + WIDTH]:
            seed = xxhash.xxh64(struct.pack("<q", w), seed=seed).intdigest()
        out.append(signed(seed))
    return out


def plain(text):
    """Two hexadecimal digits a bin."""
    least = {}
    for h in shingle_hashes(text):
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    if not least:
        return "--" * BINS
    out = []
    for b in range(BINS):
        at, k = b, 0
        while at not in least:
            step, start = (b * 0x9E3779B1 >> 7) & 127 | 1, (b + 1) * 0x85EBCA6B >> 9
            at, k = (start + step * k) & 127, k + 1
        out.append(f"{least[at] & 255:02x}")
    return "".join(out)


def likeness(a, b):
    a, b = ([x[i : i + 2] for i in range(0, len(x), 2)] for x in (a, b))
    if "--" in (a[0], b[0]):
        return float(a[0] == b[0])
    return max((sum(x == y for x, y in zip(a, b)) / BINS - 1 / 256) / (1 - 1 / 256), 0.0)


def check(spark, rows, parts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fingerprint string, ghost int").repartition(parts)
    got = [tuple(r) for r in fingerprints(docs).collect()]
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (i, text), (_, after) in zip(rows, [*rows[1:], *rows[:1]]):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own, changed = plain(text), plain(new)
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, pytest.approx(likeness(own, changed)), pytest.approx(likeness(own, plain(after)))))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("ids", [
    [2**63 - 1, -(2**63), 0, 1, None, None, 2**62, 7],
    [10**15, *range(30)],
    [5] * 12 + [None] * 9,
    [3],
])
def test_neighbours(spark, ids):
    draw = random.Random(len(ids))
    texts = [" ".join(f"Wörd{draw.randrange(40)}" for _ in range(draw.choice([0, 1, 3, 6, 200]))) for _ in ids]
    check(spark, list(zip(ids, texts)), 3)


def test_long_and_missing_texts(spark):
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    check(spark, [(1, None), (2, ""), (3, words), (4, words + " end"), (5, " \t\n"), (6, "😀" * 5 + " a b c d e f"), (7, words)], 2)
