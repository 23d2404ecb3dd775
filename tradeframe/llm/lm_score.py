"""Log-probabilities of whole texts under an n-gram model of all training texts, kept as a weighted backoff automaton.

States are contexts: the start of a text, words, pairs of words and so on that the training texts have. Each n-gram that
they have, however rare, is an arc from its context. Where a state has no arc for the next word, its failure arc leads to
the context less its first word; the last state has an arc for every word. One traversal of a text, from left to right,
carries the state on from word to word and adds the weights.

The automaton is never in one place. Texts are dealt into batches of a few megabytes; a batch asks for the counts of its
n-grams, so that its own part of the automaton is whole. Counts are summed by ranges of n-gram hashes: what moves is a
row for each batch and range, with packed keys, and it grows as the texts do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import Saved
from tradeframe.llm.words import BatchWords, mix, text_bytes

#: The end of a text, counted as a word, and the context at its start: hashes of their own.
END, START = mix(np.array([3, 5], np.uint64))

#: Bytes of text in a batch; a longer text is one by itself.
BATCH = 2 << 20

#: Bytes of text for each range of hashes, about.
RANGE = 8 << 20

#: How much an n-gram's probability in its context leans on that in the shorter one, in occurrences of the context.
LEAN = 20.0


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, each row's with END behind; row of each; whether each is its row's first."""
    words = BatchWords(column)
    hashes = np.insert(words.hashes, words.bounds[1:], END)
    size = np.diff(words.bounds) + 1
    row = np.repeat(np.arange(len(size)), size)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.empty(0, bool)
    return hashes, row, first


#: Bits of an n-gram's hash that are kept beside those that name its range.
KEPT = 48


def gram_keys(hashes: np.ndarray, first: np.ndarray, order: int, cut: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the places that have an n-gram ending there, and its key: the hash without its `cut` last bits, of
    which the last that is left tells words (1) from longer n-grams."""
    end, one = np.uint64(cut + 1), np.uint64(1 << cut)
    keys, places = hashes, np.arange(len(hashes))
    out, since = [(places, keys >> end << end | one)], places - np.maximum.accumulate(np.where(first, places, 0))
    for n in range(2, order + 1):
        before = np.concatenate([[START], keys[:-1]]) if len(keys) else keys
        if n == 2:
            before = np.where(first, START, before)
        keys = mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)
        some = np.flatnonzero(since >= n - 2)
        out.append((some, keys[some] >> end << end))
    return out


def pack(numbers: np.ndarray, size: int) -> bytes:
    """Numbers from 0 in `size` bytes each; larger ones follow in eight."""
    most = np.uint64((1 << 8 * size) - 1)
    numbers = numbers.astype("<u8")
    low = np.minimum(numbers, most)
    return np.uint32(len(numbers)).tobytes() + low.view(np.uint8).reshape(-1, 8)[:, :size].tobytes() + numbers[low == most].tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, 4).reshape(n, size)
    out = out.view("<u8")[:, 0]
    out[out == np.uint64((1 << 8 * size) - 1)] = np.frombuffer(data[4 + n * size :], "<u8")
    return out


def walk(counts: list[np.ndarray], first: np.ndarray, texts: int, tokens: int, distinct: int, lean: float = LEAN) -> tuple[np.ndarray, np.ndarray]:
    """log10 weights of the arcs taken for each word, and of the last state's arc alone.

    counts: for each order, how often training has the n-gram that ends at a place, so counts[n][i - 1] is how often it
    has the context of the one that ends at i. All places step at once, from the longest context down: a place whose
    state has an arc for the word takes it, the others take the failure arc. What a context keeps for words that never
    followed it, lean / (context + lean), is the failure arc's weight; a word that did follow it has its share beside."""
    p = (counts[0] + 1) / (tokens + distinct + 1)
    base = np.log10(p)
    weights, fails = [base], []
    for n in range(1, len(counts)):
        context = np.concatenate([[0], counts[n - 1][:-1]]) if len(first) else counts[n - 1]
        context = np.where(first, texts if n == 1 else 0, context)
        p = (counts[n] + lean * p) / (context + lean)
        weights.append(np.log10(p))
        fails.append(np.log10(lean / (context + lean)))
    total, open_ = np.zeros(len(first)), np.ones(len(first), bool)
    for n in range(len(counts) - 1, 0, -1):
        arc = open_ & (counts[n] > 0)
        total[arc] += weights[n][arc]
        open_ &= ~arc
        total[open_] += fails[n - 1][open_]
    return total + np.where(open_, base, 0), base


def _in_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """A partition's rows (id, text, ...) in batches, each with its number: cut by the bytes before a row, so the same
    rows always make the same batches."""
    number, done, held = 0, 0, []
    task = TaskContext.get().partitionId() << 32
    for batch in batches:
        _, at = text_bytes(batch.column(1))
        nth = (done + at[:-1]) // most
        done += int(at[-1])
        cuts = np.flatnonzero(np.diff(nth, prepend=nth[:1])).tolist() if len(nth) else []
        for i, j in zip([0, *cuts], [*cuts, len(nth)], strict=True):
            if i == j:
                continue
            if held and nth[i] != number:
                yield task | number, pa.Table.from_batches(held)
                held = []
            number = int(nth[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield task | number, pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    got = table[name].combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def _asked(rows: DataFrame, order: int, bits: int, most: int) -> DataFrame:
    """(part, batch, keys, n): the distinct n-grams of each batch by ranges of their keys, in order, and how often its
    training texts have each; whole batches of rows (id, text, learn)."""
    cut = max(0, 64 - KEPT - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _in_batches(batches, most):
            hashes, row, first = tokens_of(_column(table, "text"))
            learn = _column(table, "learn").to_numpy(zero_copy_only=False)[row]
            grams = gram_keys(hashes, first, order, cut)
            keys = np.unique(np.concatenate([k for _, k in grams]))
            known, times = np.unique(np.concatenate([k[learn[at]] for at, k in grams]), return_counts=True)
            n = np.zeros(len(keys), np.uint64)
            n[np.searchsorted(keys, known)] = times
            part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(keys))
            own = keys << np.uint64(bits) >> np.uint64(bits + cut)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts]),
                    pa.array(np.full(len(cuts), number), pa.int64()),
                    # steps from key to key, which take five bytes
                    pa.array([pack(np.diff(own[i:j], prepend=np.uint64(0)), 5) for i, j in zip(cuts, ends, strict=True)], pa.binary()),
                    pa.array([pack(n[i:j], 1) for i, j in zip(cuts, ends, strict=True)], pa.binary()),
                ],
                ["part", "batch", "keys", "n"],
            )

    return rows.mapInArrow(run, "part bigint, batch bigint, keys binary, n binary")


def _sums(table: pa.Table, bits: int) -> pa.Table:
    """Of one range: to each batch's n-grams how often all training texts have them; and, once, the sum over the range's words,
    how many of them training has, and the number of texts if their end is here."""
    parts = [np.cumsum(unpack(x.as_py(), 5), dtype=np.uint64) for x in table["keys"]]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack(x.as_py(), 1) for x in table["n"]]), len(keys)).astype(np.int64)
    words = (keys & np.uint64(1)).astype(bool)
    ends = np.cumsum([len(x) for x in parts])
    found = total[at]
    cut = max(0, 64 - KEPT - bits)
    end = gram_keys(np.array([END]), np.array([True]), 1, cut)[0][1]
    here = int(end[0]) >> (64 - bits) if bits else 0
    end = end << np.uint64(bits) >> np.uint64(bits + cut) if here == table["part"][0].as_py() else np.empty(0, np.uint64)
    once = lambda x: pa.array([int(x)] + [0] * (len(parts) - 1), pa.int64())
    return pa.table(
        {
            "part": table["part"], "batch": table["batch"], "sums": pa.array([pack(found[e - len(x) : e], 1) for x, e in zip(parts, ends.tolist(), strict=True)], pa.binary()),
            "tokens": once(total[words].sum()), "known": once((total[words] > 0).sum()), "texts": once(total[np.isin(keys, end)].sum()),
        }
    )


def lm_scores(docs: DataFrame, held_out: int = 2, folds: int = 7, order: int = 3, lean: float = LEAN, most: int = BATCH, range_bytes: int = RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    The model learns from rows whose crc32(id as text) mod `folds` is not `held_out`, all their n-grams up to `order`
    words. Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, and one end for each text. base_score: add-one
    unigrams; score: the automaton. A null or empty text is its end alone; a row of null id is scored and not learnt from
    (its held_out is null); repeated rows count and are scored each; other columns are not read; an empty table gives no
    rows. docs must give the same rows in the same order when read again, as files do; if it doesn't, the query fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(F.crc32(F.col("id").cast("string")) % folds != held_out, F.lit(False)))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (-(-size // range_bytes) - 1).bit_length())
    sums = Saved(_asked(rows, order, bits, most).groupBy("part").applyInArrow(lambda table: _sums(table, bits), "part bigint, batch bigint, sums binary, tokens bigint, known bigint, texts bigint"), "sums").df
    tokens, distinct, texts = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("known"), F.sum("texts")).first())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _in_batches(batches, most):
            n = table.num_rows
            for batch in table.to_batches():
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.full(n, -1)), batch.column(0), batch.column(1), pa.nulls(n, pa.binary())], ["batch", "part", "id", "text", "sums"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def one() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            of_text = np.asarray(table["part"]) < 0
            asked = table.filter(pa.array(of_text))
            hashes, row, first = tokens_of(_column(asked, "text"))
            grams = gram_keys(hashes, first, order, max(0, 64 - KEPT - bits))
            keys, at = np.unique(np.concatenate([k for _, k in grams]), return_inverse=True)
            total = np.concatenate([np.empty(0, np.uint64), *(unpack(x.as_py(), 1) for x in table.filter(pa.array(~of_text))["sums"])]).astype(np.int64)
            if len(total) != len(keys):
                raise RuntimeError("docs gave other rows when they were read again: write them to a table first")
            found, counts = np.split(total[at], np.cumsum([len(k) for _, k in grams])[:-1]), []
            for (places, _), c in zip(grams, found, strict=True):
                counts.append(np.zeros(len(hashes), np.int64))
                counts[-1][places] = c
            best, base = walk(counts, first, texts, tokens, distinct, lean)
            k = asked.num_rows
            number = lambda w: np.bincount(row, w, k)
            return pa.RecordBatch.from_arrays([_column(asked, "id"), pa.array(np.bincount(row, minlength=k)), pa.array(number(counts[0] > 0).astype(np.int64)), pa.array(number(base)), pa.array(number(best))], ["id", "n", "known", "base", "score"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if i < j:
                    if held and held[-1].column(0)[0].as_py() != numbers[i]:
                        yield one()
                        held = []
                    held.append(batch.slice(i, j - i))
        if held:
            yield one()

    schema = "batch bigint, part bigint, id bigint, text string, sums binary"
    null = F.lit(None)
    both = rows.mapInArrow(numbered, schema).union(sums.select("batch", "part", null.cast("bigint"), null.cast("string"), "sums"))
    scored = both.repartition("batch").sortWithinPartitions("batch", "part").mapInArrow(score, "id bigint, n bigint, known bigint, base double, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (F.crc32(F.col("id").cast("string")) % folds == held_out).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
