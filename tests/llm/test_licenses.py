"""Licence detections against the same rules in plain Python."""

import random
import re

import pytest

from tradeframe.llm.license_rules import KINDS, RULES, keyword_pattern, rules
from tradeframe.llm.licenses import document_licenses, license_detections

SCHEMA = "doc_id bigint, text string, n_words int, detections string, label string"
PIECES = """under the MIT License|Licensed under the Apache License, Version 2.0.|Licensed under CC BY-NC 4.0.|CC BY NC|cc-by-nc|mit|apache license version 2|the|license|SPDX-License-Identifier: GPL-3.0-or-later
This work is licensed under the GNU General Public License, version 3.|GNU Lesser General Public License v2.1|https://creativecommons.org/licenses/by-nc-sa/4.0/|All rights reserved|public domain|CC0|WTFPL|größe|2|0|version|under the terms of the
released under the BSD 3-Clause license|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")|under the|the MIT license|Creative Commons Attribution-ShareAlike 4.0 International License""".replace("\n", "|").split("|")


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    line = " " + " ".join(words) + " " if words else ""
    found = [(line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), r.level, r.number, r.label) for r in rules() for m in re.finditer(r.pattern, line)]
    kept = []
    for d in found:
        over = [e for e in found if e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[3] < d[3]))]
        if not over or d[2] == 0:
            kept.append(d)
    return len(words), sorted(kept)


def digest(n, kept):
    base = [d for d in kept if d[2] == 0]
    sure, doubt = list(KINDS.values()), 1.0
    for label in {d[4] for d in kept}:
        doubt *= 1 - max(sure[d[2]] for d in kept if d[4] == label)
    labels = lambda of: ",".join(sorted({d[4] for d in of}))
    starts = [d[0] for d in base]
    return (n, len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(kept), pytest.approx(1 - doubt), len(kept))


def test_rules_are_in_order_and_keywords_stand_alone():
    of = rules()
    assert len(of) == len(RULES.strip().splitlines()) > 200 and [r.level for r in of] == sorted(r.level for r in of)
    words = {k for r in of for k in r.keywords}
    stems = {k[:-1] for k in words if k.endswith("*")}
    assert not [(s, k) for s in stems for k in words if k.rstrip("*") != s and k.startswith(s)]


def test_gate_drops_no_match():
    """A text that a rule's expression matches has its keywords."""
    of, gate = rules(), re.compile(keyword_pattern(rules()))
    for seed in range(400):
        draw = random.Random(seed)
        line = " " + " ".join(re.findall(r"[a-z0-9ö]+", " ".join(draw.choice(PIECES) for _ in range(5)).lower())) + " "
        has = set(gate.findall(line))
        for r in of:
            if re.search(r.pattern, line):
                assert {k.rstrip("*") for k in r.keywords} <= has, (r, line)


def test_equals_brute_force(spark):
    texts = []
    for seed in range(150):
        draw = random.Random(seed)
        texts.append(draw.choice([" ", ", ", "\n", "\x00"]).join(draw.choice(PIECES) for _ in range(draw.randint(1, 12))))
    texts += [None, "", " \n.", "中文 MIT", "Kelvin K under the MIT License \x1c", "cc by nc " * 3000, "x " * 60_000 + "under the mit license", "word" * 100_000]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "a", "b") for i, t in enumerate(texts)], SCHEMA)
    docs = docs.union(docs.limit(2)).repartition(3)
    got = [tuple(r) for r in document_licenses(docs).collect()]
    want = {t: digest(*brute(t)) for t in texts}
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(got) == len(texts) + 2
    for i, t in rows:
        assert (i, *want[t]) in got
    spans = {r.text: [(d.start, d.end, d.level, d.number, d.label) for d in r.detections] for r in license_detections(docs.select("text")).collect()}
    for t in texts:
        if t is None or len(t) < 20_000:
            assert sorted(spans[t]) == brute(t)[1]
    assert document_licenses(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text, labels", [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0-only"),
    ("either GNU GPL... SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("Das ist mit der Lizenz", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-2-clause,bsd-3-clause"),
])
def test_labels(spark, text, labels):
    assert document_licenses(spark.createDataFrame([(1, text, 1, "", "")], SCHEMA)).first().labels == labels
