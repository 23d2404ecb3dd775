"""Similarity operators against brute force on small tables."""

import hashlib
import random
from fractions import Fraction

import pytest

from tradeframe.llm.components import components
from tradeframe.llm.decontaminate import contaminated
from tradeframe.llm.fingerprints import fingerprints
from tradeframe.llm.lm_score import lm_scores
from tradeframe.llm.ngram_jaccard import jaccard_components
from tradeframe.llm.passages import cut_passages, repeated_passages
from tradeframe.llm.toxicity import toxicity
from tradeframe.llm.warc import derivative_records, read_warc, record_bytes, responses


def words(n, seed, vocabulary=3000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def edited(text, changes, seed):
    draw, out = random.Random(seed), list(text)
    for _ in range(changes):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def copies(spark):
    base = words(150, 1)
    rows = [" ".join(edited(base, k % 7, k)) for k in range(120)] + [" ".join(words(n, n)) for n in (1, 2, 3, 9, 400)]
    rows += [" ".join(base), " ".join(base).upper(), None, "", " \t", "one", "one"]
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)] + [(None, "one", 0)], "doc_id bigint, text string, n_shingles int")


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width,threshold", [(3, Fraction(9, 10)), (5, Fraction(8, 10))])
def test_jaccard(spark, copies, width, threshold):
    rows = [r for r in copies.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text, width) for r in rows}
    label = {i: i for i in sets}
    for _ in sets:
        new = dict(label)
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and len(a & b) >= threshold * len(a | b):
                    new[i] = min(new[i], label[j])
        if new == label:
            break
        label = new
    got = jaccard_components(copies, width, threshold).collect()
    assert len(got) == copies.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), label[i]) for i, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_components(copies.limit(0), width, threshold).count() == 0


def test_jaccard_of_a_large_group(spark):
    """Copies of one text, edited each in its way: alike to the text, but seldom to each other; and chains of edits."""
    base = words(200, 77)
    texts = [edited(base, 3, 1000 + k) for k in range(500)] + [base]
    for k in range(40):
        texts.append(edited(texts[-1] if k % 10 else edited(base, 9, 3000 + k), 2, 2000 + k))
    draw = random.Random(9)
    draw.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(7)
    sets = [shingles(" ".join(t), 5) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in range(len(sets))}
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).df.collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_fingerprints(spark, copies):
    some = copies.where("doc_id is not null").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fingerprints(copies.where("doc_id is not null")).collect()}
    assert len(got) == len(some)
    for r, after in zip(some, [*some[1:], some[0]]):
        text, half = r.text or "", len(r.text or "") // 2
        new = text[: len(text) - half] + (after.text or "")[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for other, near in ((new, g.near_edited), (after.text, g.near_next)):
            a, b = shingles(text, 5), shingles(other, 5)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[120].fingerprint != got[124].fingerprint
    assert fingerprints(copies).count() == copies.count() and fingerprints(copies.limit(0)).count() == 0


def test_passages(spark):
    shared = words(90, 50)
    texts = {1: words(200, 2) + shared + words(100, 3), 2: words(30, 4) + edited(shared, 4, 9) + words(150, 5), 3: words(300, 6), 4: shared[:30] + words(80, 7), 5: None, 6: []}
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t), 1) for i, t in texts.items()], "doc_id bigint, text string, first_word int")
    found = repeated_passages(docs)
    got = found.collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(2, 1)}
    assert min(r.first_word for r in got) <= 40 and max(r.end_word for r in got) >= 110 and all(r.likeness >= 0.8 for r in got)
    cut = {r.doc_id: r.text for r in cut_passages(docs, found).collect()}
    assert cut[1] == " ".join(texts[1]) and cut[5] is None and cut[6] == ""
    assert len(cut[2].split()) <= 200 and cut[2].split()[-150:] == texts[2][-150:]
    assert repeated_passages(docs.limit(0)).count() == 0


def test_contaminated(spark):
    item = "A train from Leeds covers 120 km in 3 hours while another train leaves York and covers 80 km in 3 hours over the old line"
    other = item.replace("Leeds", "Derby").replace("120", "95").replace("3", "4")
    broken = item.replace("in 3 hours while", "in 5 hours while")
    docs = [(1, f"Intro words here. {item} and more."), (2, f"Some text, {other} then on."), (3, " ".join(words(80, 8))), (4, None), (5, ""), (None, item), (6, item.lower().replace(" ", "  "))]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id bigint, text string, coverage double")
    bench = spark.createDataFrame([(7, item), (8, " ".join(words(30, 12))), (9, None), (10, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(frame, bench).collect()}
    assert {(1, 7), (2, 7)} <= set(got) and all(k[1] == 7 and k[0] in (1, 2, 6) for k in got)
    assert not got[(2, 7)].exact
    assert contaminated(frame, bench.limit(0)).count() == 0 and contaminated(frame.limit(0), bench).count() == 0
    assert broken != item


def test_contaminated_by_other_readings(spark, monkeypatch):
    """Numbers with marks, words put in, names at sentences' beginnings, number tables and short items."""
    from tradeframe.llm import decontaminate

    item = "Anna bought 12 pens in the small shop at the corner for the children. Bernd paid 40 dollars for all of them and then they walked home along the wide river"
    put_in = item.replace("12", "1,250.75").replace("40", "3.50").replace("small shop", "very small old shop").replace("wide river", "wide slow river")
    names = item.replace("Anna", "Clara").replace("Bernd", "Dieter")
    table = " ".join(str(7 * i % 23) for i in range(40))
    docs = [(1, put_in), (2, names), (3, item.lower()), (4, "x y " + table + " z"), (5, table.replace("7", "8")), (6, "we saw blue moon rising there"), (7, "we saw a blue and moon rising"), (8, item.replace(" 40 ", " 12 "))]
    docs += [(9, ("word " * 3000) + item + (" other" * 3000)), (9, None), (10, item), (10, item)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, size string")
    bench = spark.createDataFrame([(1, item, 1), (1, item, 2), (2, table, 1), (3, "Blue moon rising", 1), (4, "", 1), (None, item, 1)], "item_id bigint, text string, words int")
    for sent in (decontaminate.SENT, 3):
        monkeypatch.setattr(decontaminate, "SENT", sent)
        got = {(r.doc_id, r.item_id): r for r in contaminated(frame, bench).collect()}
        assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 3), (8, 1), (9, 1), (10, 1)}
        assert got[9, 1].exact and (got[9, 1].first_word, got[9, 1].end_word) == (3000, 3000 + len(item.split())) and not got[1, 1].exact
        assert got[8, 1].coverage < 1 and got[10, 1].coverage == 1


def test_toxicity(spark):
    bad = ["vile", "rotten", "vileness"]
    draw = random.Random(4)
    rows = [(i, " ".join(words(40, i) + ([draw.choice(bad)] * 2 if i % 5 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vile")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 403
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score < 0.5 <= got[None].score
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_language_model(spark):
    import math
    import zlib
    from collections import Counter

    def chain(seed):
        draw, out = random.Random(seed), [0]
        for _ in range(50):
            out.append((out[-1] * 3 + 1) % 41 if draw.random() < 0.8 else draw.randrange(41))
        return " ".join(f"w{x}" for x in out)

    rows = [(i, chain(i)) for i in range(120)] + [(500, None), (501, ""), (502, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_scores(docs).collect()}
    counts = Counter()
    token = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(token(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t))
        assert abs(got[i].base_score - want) < 1e-6 and got[i].n_known == sum(counts[w] > 0 for w in token(t)) and got[i].train_tokens == n
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(docs.limit(0)).count() == 0


def test_warc(spark):
    import gzip

    page = "<html lang='de'><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One <b>two</b></p><script>var t='</p>';</script><a href='/next'>three</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/", page), (2, "http://b.example/", None), (3, None, "")], "page_id bigint, url string, html string")
    got = derivative_records(responses(pages)).collect()
    assert len(got) == 6
    text = next(r for r in got if r.page == 1 and r.record_type == "conversion")
    meta = next(r for r in got if r.page == 1 and r.record_type == "metadata")
    assert text.block == "One two\nthree" and text.refers_to == meta.refers_to and text.record_id != meta.record_id
    assert "title: A & B\r\n" in meta.block and "language: de\r\n" in meta.block and "outlink: /next\r\n" in meta.block
    back = list(read_warc(gzip.compress(record_bytes(text.asDict()))))
    assert back[0][0]["WARC-Refers-To"] == [text.refers_to] and back[0][1] == text.block.encode()
    assert derivative_records(responses(pages.limit(0))).count() == 0
