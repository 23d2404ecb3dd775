"""The trie of conversations against a plain one in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tradeframe.llm.turn_trie import conversation_trie, prefix_trie, rebuilt, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, c int, n int, place string, stretch int"


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()[:12]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, turn_key(role, text), (role or "", text or "")))
    convs = {c: [t[-1] for t in sorted(v, key=lambda t: (t[:3], len(t[3][1])))] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        origin = c - int(c / 100) * 100
        made[c] = convs.get(c - origin, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        below = [out[p] for p in children[path]]
        leaves = sum(b[5] for b in below) if below else 1
        saved = sum(b[6] for b in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(made[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[path] = (min(members[path]), len(path), parent, len(members[path]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda t: (t[1], t[0]))


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "x", 7) for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-150, 450), n):
        turn = draw.sample(range(1000), draw.randint(1, longest))
        rows += [(c, t, draw.choice(["user", "bot", None]), draw.choice(["hi", "Größe 😀", "", None])) for t in turn]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: (t[1], t[0]))


@pytest.mark.parametrize("seed, n, longest, size", [(1, 60, 4, 1 << 15), (2, 120, 30, 16), (3, 5, 90, 8)])
def test_trie(spark, seed, n, longest, size):
    rows = random_rows(seed, n, longest)
    assert got(prefix_trie(rebuilt(turns(table(spark, rows)), size), size)) == brute(rows)


def test_copies_nulls_ties_and_long_texts(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100, 190) for t in range(12)]  # copies of one conversation
    rows += [(7, None, None, None), (7, None, "user", "x"), (7, 3, "bot", "y"), (7, 3, "bot", "y"), (7, 3, "bot", "z")]
    rows += [(None, 1, "user", "lost"), (5000, 0, "user", "L" * 300_000), (5001, 1, "user", "alone"), (2**62, 0, "a", "b"), (-(2**62), 0, "a", "b")]
    assert got(conversation_trie(table(spark, rows))) == brute(rows)


def test_hot_end(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 9000, 3)]
    assert got(conversation_trie(table(spark, rows))) == brute(rows)


def test_empty(spark):
    empty = table(spark, [(1, 1, "a", "b")])
    assert conversation_trie(empty.limit(0)).collect() == [] and conversation_trie(empty.where("conv_id = 2")).collect() == []
