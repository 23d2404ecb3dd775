"""The stages of the corpus pipeline on a small corpus with planted cases, each against brute force on its own input."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradeframe.llm import queries
from tradeframe.llm.tokenizing import encoder

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def words_of(seed, n):
    draw = random.Random(seed)
    return [f"{draw.choice('bdfglm')}{draw.choice('aeiou')}{draw.randrange(10**5)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with planted rows of ids from 10,000 on and an extra column."""
    where = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("x"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").first().text
    passage = " ".join(words_of(5, 70))
    long = " ".join(words_of(6, 9000))
    base = words_of(1, 120)
    near = list(base)
    near[60] = "changed"
    rows = {
        10_000: " ".join(base), 10_001: " ".join(near), 10_002: " ".join(base).upper(), 10_003: " ".join(words_of(2, 30) + [passage] + words_of(3, 30)), 10_004: " ".join(words_of(7, 40) + [passage] + words_of(8, 25)),
        10_005: " ".join(words_of(9, 40) + [item] + words_of(10, 40)), 10_006: toxic + " " + toxic, 10_007: None, 10_008: "", 10_009: " \n\t", 10_010: long, 10_011: " ".join(words_of(11, 200)), None: " ".join(words_of(12, 60)),
    }
    planted = [(i, t, "en", "src0", None if t is None else len(t), "y") for i, t in rows.items()]
    planted += [p for p in planted if p[0] == 10_011]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
    docs.select(*(c.split()[0] for c in schema.split(", "))).unionByName(spark.createDataFrame(planted, schema)).repartition(3).write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows before the first stage and after each; a stage's are written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/step{i}")
        out.append(spark.read.parquet(f"{folder}/step{i}"))
    return [df.collect() for df in out]


def test_stages_keep_the_columns(steps):
    for rows in steps[1:-1]:
        assert rows[0].__fields__ == steps[0][0].__fields__


def test_toxic_documents_go(spark, steps):
    before, after = ({r.doc_id for r in s} for s in steps[:2])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = before - after
    toxic = {i for i, y in labels.items() if y == 1} & before
    assert 10_006 in gone and len(gone & toxic) >= 0.9 * len(toxic)
    assert not {i for i in gone if labels.get(i) == 0 or (i or 0) >= 10_000} - {10_006} and None in after
    assert Counter(r.doc_id for r in steps[1])[10_011] == 2


def test_one_of_each_group_of_near_copies_stays(steps):
    rows = [r for r in steps[1] if r.doc_id is not None]
    sets = defaultdict(set)
    for r in rows:
        sets[r.doc_id] |= shingles(r.text)
    meets = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            meets[x].add(i)
    label = {i: i for i in sets}
    links = {(a, b) for ids in meets.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in links if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = Counter(r.doc_id for r in rows if label[r.doc_id] == r.doc_id)
    got = Counter(r.doc_id for r in steps[2] if r.doc_id is not None)
    assert got == want and got[10_000] == 1 and not got[10_001] + got[10_002]
    assert sum(r.doc_id is None for r in steps[2]) == 1


def test_repeated_passages_are_cut(steps):
    before, after = ({r.doc_id: r for r in s} for s in steps[2:4])
    assert Counter(r.doc_id for r in steps[2]) == Counter(r.doc_id for r in steps[3])
    passage = " ".join(words_of(5, 70))
    assert passage in after[10_003].text and after[10_004].text == " ".join(words_of(7, 40) + words_of(8, 25))
    grams = defaultdict(set)
    for i, r in before.items():
        for g in shingles(r.text):
            grams[g].add(i)
    for i, r in before.items():
        new = after[i].text
        assert after[i].n_chars == (None if new is None else len(new))
        if i is None or not any(len(grams[g]) > 1 for g in shingles(r.text)):  # nothing shared: as it was
            assert new == r.text
        elif new is not None:  # only words go, and none is moved
            left = iter((r.text or "").split())
            assert all(w in left for w in new.split())


def test_benchmark_documents_go(steps):
    before, after = (Counter(r.doc_id for r in s) for s in steps[3:5])
    assert before[10_005] == 1 and not after[10_005] and after[None] == 1
    assert all(after[i] == n for i, n in before.items() if (i or 0) >= 10_000 and i != 10_005)
    assert sum(after.values()) > 0.8 * sum(before.values())


def test_all_tokens_are_packed_once(steps):
    code = encoder(queries.vocabulary())
    want = Counter()
    for r in steps[4]:
        want[r.doc_id, len(code.whole(r.text or "")) + 1] += 1
    got, room = defaultdict(int), defaultdict(list)
    for r in steps[5]:
        got[r.doc_id, r.doc_tokens] += r.length
        room[r.sequence_id].append((r.offset, r.length))
    assert {k: n * k[1] for k, n in want.items()} == dict(got)
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
