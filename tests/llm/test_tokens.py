"""Token operators against the tokenizers library; token files as a round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tradeframe.llm.packing import pack_documents
from tradeframe.llm.queries import vocabulary
from tradeframe.llm.shared import scratch
from tradeframe.llm.token_count import counter, token_counts
from tradeframe.llm.token_files import BLOCK, pack, read_tokens, unpack, write_tokens
from tradeframe.llm.tokenizing import encoder

PARTS = ["<|endoftext|>", " ", "\n", "don't", "'s", "\t", "  ", "　", "\x1c", "é", "12", "...", "\n\n", " \n", "\n ", "中文", "😀", " the", "word, ", "end.", "\x85", "A!"]


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(n)] + [None, "", "x" * 3000, "ab " * 5000]


def test_encoder_and_counter_equal_the_library():
    some = pa.array(texts(1500, 1), pa.string())
    codes, counts = encoder(vocabulary()), counter(vocabulary())
    flat, at = codes.encode(some)
    n = counts.count(some)
    for i, text in enumerate(some.to_pylist()):
        want = codes.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert flat[at[i] : at[i + 1]].tolist() == want
        assert n[i] == len(want)


def test_blocks_round_trip():
    draw = np.random.default_rng(5)
    for n in (1, 255, 256, 257, 3000):
        for high in (1, 2, 300, 50_000, 2**32 - 1):
            ids = draw.integers(0, high, n, dtype=np.uint32)
            ids[draw.random(n) < 0.03] = 2**32 - 1
            blocks, sizes = pack(ids)
            back = unpack(np.frombuffer(b"".join(blocks), np.uint8), np.cumsum(sizes) - sizes)
            assert (back[:n] == ids).all() and len(back) == -(-n // BLOCK) * BLOCK
    assert pack(np.empty(0, np.uint32))[0] == []


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(200, 2))] + [(None, "lost id", "x"), (3, "again", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)


def test_counts(spark, docs):
    got = token_counts(docs, vocabulary()).collect()
    assert len(got) == docs.count()
    by = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got)
    codes = encoder(vocabulary())
    want = sorted((r.doc_id is None, r.doc_id or 0, len(codes.whole(r.text or ""))) for r in docs.collect())
    assert by == want
    assert token_counts(docs.limit(0), vocabulary()).count() == 0


def test_token_files(spark, docs):
    path = scratch(spark, "tokens")
    got = read_tokens(spark, path, write_tokens(docs, path, vocabulary())).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    codes, start = encoder(vocabulary()), 0
    for r, g in zip(rows, sorted(got, key=lambda g: g.start)):
        ids = np.array([*codes.whole(r.text or ""), 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = scratch(spark, "tokens")
    assert read_tokens(spark, path, write_tokens(docs.limit(0), path, vocabulary())).count() == 0


def test_token_files_are_rolled(spark, docs):
    many = docs.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id < 50").selectExpr("9223372036854775807", "text")).union(docs.select("doc_id", "text").where("doc_id < 50").selectExpr("-9223372036854775807", "text"))
    path = scratch(spark, "tokens")
    manifest = write_tokens(many, path, vocabulary(), most_bytes=2_000)
    assert manifest.count() > 4 and manifest.agg({"n_docs": "sum"}).first()[0] == many.count()
    got = sorted(read_tokens(spark, path, manifest).collect(), key=lambda r: r.start)
    rows = sorted(many.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    codes, start = encoder(vocabulary()), 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*codes.whole(r.text or ""), 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing(spark, docs):
    got = pack_documents(docs.where("doc_id is not null and doc_id <> 3"), vocabulary(), capacity=128).collect()
    codes, seen, filled = encoder(vocabulary()), {}, {}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = np.array([*codes.whole(text[r.doc_id]), 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, pieces in seen.items():
        assert [a for a, _ in sorted(pieces)] == list(np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1])
        assert sum(n for _, n in pieces) == len(codes.whole(text[doc])) + 1
    for pieces in filled.values():
        pieces.sort()
        total = sum(n for _, n in pieces)
        assert [a for a, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1])
        assert total <= 128 and total & (total - 1) == 0
    assert pack_documents(docs.limit(0), vocabulary()).count() == 0
