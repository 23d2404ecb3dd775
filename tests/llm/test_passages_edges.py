"""Repeated passages where texts are missing, short or not ASCII."""

from tradeframe.llm.passages import cut_passages, repeated_passages

SCHEMA = "doc_id long, text string, here int, low int, ours string"


def test_edges(spark):
    passage = " ".join(f"wörd{i}" for i in range(60))
    rows = [(1, f"Ü {passage.upper().replace('Ö', 'ö')} end"), (2, f"αβγ  other\t{passage}"), (3, None), (4, ""), (5, "short"), (None, passage), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in rows], SCHEMA)
    found = repeated_passages(docs)
    assert [(r.doc_id, r.first_word, r.end_word, r.source_id, r.source_first, r.source_end) for r in found.collect()] == [(2, 2, 62, 1, 1, 61)]
    left = {r.doc_id: r.text for r in cut_passages(docs, found).collect()}
    assert left == dict(rows) | {2: "αβγ  other"}
    assert repeated_passages(docs.limit(0)).count() == 0
