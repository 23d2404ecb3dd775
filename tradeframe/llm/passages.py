"""Passages that a document shares with an earlier one, found by chaining shared k-mers.

Of each window of neighbouring word k-mers the one of least hash is a seed (so texts that share a window share its
seed). Each seed of a document is matched to the first place that has it: one match a seed, however many places have
it. A document's matches with one earlier document are chained: in both texts in order, at a cost for the gaps, found
with a Fenwick tree. Chains are aligned with both texts, extended at their ends, and kept if long and alike enough; of one
that isn't alike enough as a whole, the parts that are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import Saved, over_batches, saved, small_batches
from tradeframe.llm.words import BatchWords, window_hashes


@dataclass(frozen=True)
class Passages:
    """words: of a k-mer; window: k-mers of which one is a seed; least: words of a passage; alike: share of its words
    that the two texts have in common; gap: words between two matches of a chain; edge: words beyond a chain's ends
    that the alignment may reach."""

    words: int = 8
    window: int = 16
    least: int = 50
    alike: float = 0.8
    gap: int = 48
    edge: int = 64


def seeds(grams: np.ndarray, p: Passages) -> np.ndarray:
    """Places of the seeds among a row's k-mer hashes: in each window the least hash, the last of equals."""
    n = len(grams) - p.window + 1
    if n <= 0:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else [], np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, p.window)
    return np.unique(np.arange(n) + p.window - 1 - np.argmin(view[:, ::-1], axis=1))


class Fenwick:
    """The greatest value put at a place at or below another."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def most(self, place: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while place > 0:
            out = max(out, self.best[place])
            place -= place & -place
        return out


#: A chain loses so much for each word of its gaps, in words of a match.
GAP_COST = 0.05


def chains(matches: list[tuple[int, int]], p: Passages) -> list[list[tuple[int, int]]]:
    """Best chains of matches (place here, place there), both rising, the longest first; a match is in one chain at
    most. No chain goes over a gap wider than `gap` words in either text, so each stretch without such a gap here is
    chained for itself. Where all matches of a stretch rise in both texts, the best chain is all of them: any match
    between two others adds its words and no gap."""
    places, out = np.array(sorted(set(matches)), np.int64), []
    for part in np.split(places, np.flatnonzero(np.diff(places[:, 0]) > p.gap) + 1):
        step = np.diff(part, axis=0)
        if (step > 0).all():
            out += [list(zip(*run.T.tolist(), strict=True)) for run in np.split(part, np.flatnonzero(step[:, 1] > p.gap) + 1)]
        else:
            out += _mixed_chains([(i, j) for i, j in part.tolist()], p)
    return sorted(out, key=lambda c: (-len(c), c))


def _mixed_chains(matches: list[tuple[int, int]], p: Passages) -> list[list[tuple[int, int]]]:
    """chains() of matches, in order, that don't all rise. Scores are found once; chains are then taken from the ends of
    the highest scores, each back to the first match that an earlier chain has."""
    there = {q: i for i, q in enumerate(sorted({q for _, q in matches}))}
    tree, score, back = Fenwick(len(there)), [0.0] * len(matches), [-1] * len(matches)
    for _, row in groupby(range(len(matches)), key=lambda k: matches[k][0]):
        row = list(row)
        for k in row:
            here, that = matches[k]
            value, before = tree.most(there[that])
            gain = value - GAP_COST * (here + that)
            score[k], back[k] = (p.words + gain, before) if gain > 0 else (float(p.words), -1)
        # matches of one place here can't follow each other
        for k in row:
            here, that = matches[k]
            tree.put(there[that], (score[k] + GAP_COST * (here + that), k))
    out, used = [], [False] * len(matches)
    for k in sorted(range(len(matches)), key=lambda k: (-score[k], k)):
        run: list[tuple[int, int]] = []
        while k >= 0 and not used[k]:
            used[k] = True
            if run and (run[-1][0] - matches[k][0] > p.gap or run[-1][1] - matches[k][1] > p.gap):
                out.append(run[::-1])
                run = []
            run.append(matches[k])
            k = back[k]
        if run:
            out.append(run[::-1])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a longest common subsequence of two short stretches."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= len(a) - 2:
            return same
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(np.maximum.accumulate(np.where(b == x, row[:-1] + 1, 0)), row[1:])
    return int(row[-1])


def reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two texts that run on from one place stay alike: (words, of them the same), at the best sum of +1 for a
    word that is the same and -2 for one that isn't."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    worth = np.cumsum(np.where(same, 1, -2))
    k = int(np.argmax(worth))
    return (k + 1, int(same[: k + 1].sum())) if worth[k] > 0 else (0, 0)


def align(here: np.ndarray, there: np.ndarray, chain: list[tuple[int, int]], p: Passages) -> tuple[int, int, int, int, float]:
    """(start, end, start there, end there, likeness) of a chain in the word hashes of both texts, extended."""
    same, (i, j) = 0, chain[0]
    x, y = i, j
    for a, b in [*chain[1:], (chain[-1][0] + p.words, chain[-1][1] + p.words)]:
        same += common(here[x:a], there[y:b])
        x, y = a, b
    n, s = reach(here[max(0, i - p.edge) : i][::-1], there[max(0, j - p.edge) : j][::-1])
    m, t = reach(here[x : x + p.edge], there[y : y + p.edge])
    start, end, start_there, end_there = i - n, min(x + m, len(here)), j - n, min(y + m, len(there))
    return start, end, start_there, end_there, (same + s + t) / max(end - start, end_there - start_there, 1)


def aligned(here: np.ndarray, there: np.ndarray, chain: list[tuple[int, int]], p: Passages) -> list[tuple[int, int, int, int, float]]:
    """align() of a chain if it is long and alike enough; of one that isn't alike enough, the same of its parts: the part
    whose words in common exceed `alike` of its length by most, then those of what is left on both sides."""
    out, left = [], [chain]
    while left:
        part = left.pop()
        found = align(here, there, part, p)
        if found[4] >= p.alike:
            out.append(found)
            continue
        steps = [common(here[i:a], there[j:b]) - p.alike * max(a - i, b - j) for (i, j), (a, b) in zip(part, part[1:], strict=False)]
        # the greatest sum of neighbouring steps; a single match has none
        best, first, last, total, start = 0.0, 0, 0, 0.0, 0
        for k, step in enumerate(steps, 1):
            total += step
            if total > best:
                best, first, last = total, start, k
            if total <= 0:
                total, start = 0.0, k
        # its ends without the extension, where only that makes it too unlike
        core = [align(here, there, part[first : last + 1], q) for q in (p, replace(p, edge=0))]
        out += [x for x in core if x[4] >= p.alike][:1]
        left += [x for x in (part[:first], part[last + 1 :]) if x]
    return [x for x in out if x[1] - x[0] >= p.least]


def _seed_rows(rows: DataFrame, p: Passages) -> DataFrame:
    """(seed, id, pos, low, high): low and high are the bytes of the text from `edge` words before the seed to `edge` words behind it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = BatchWords(batch.column(1))
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for i in range(len(words)):
            hashes = window_hashes(words.of(i), p.words)
            at = seeds(hashes, p)
            first, n = words.bounds[i], words.bounds[i + 1] - words.bounds[i]
            low = words.starts[first + np.maximum(at - p.edge, 0)] - words.rows[i]
            high = words.ends[first + np.minimum(at + p.words + p.edge, n) - 1] - words.rows[i]
            for column, part in zip(columns, (hashes[at], at, low, high), strict=True):
                column.append(part)
        row = pa.array(np.repeat(np.arange(len(words)), [len(x) for x in columns[1]]))
        flat = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
        places = [pa.array(flat(parts, np.int32)) for parts in columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array(flat(columns[0], np.uint64).view(np.int64)), batch.column(0).take(row), *places], ["seed", "id", "pos", "low", "high"])

    return over_batches(rows, run, "seed bigint, id bigint, pos int, low int, high int", most=BATCH)


#: Bytes of texts or matches that a Python worker takes at once: what it works out of them is some fifty times as much.
BATCH = 1 << 20

#: What chain() and verify() of repeated_passages return.
SPANS = "here bigint, there bigint, a bigint, c bigint, low bigint, high bigint, low_there bigint, high_there bigint, chain array<bigint>"
FOUND = ["id", "first_word", "end_word", "source_id", "source_first", "source_end", "likeness"]


def _with_stretch(rows: DataFrame, spans: DataFrame, key: str, low: str, high: str, out: str) -> DataFrame:
    """spans with the bytes of a stretch of the text of the row whose id is in `key`, in place of the stretch's bounds. Spark
    cuts it: whole texts go no further than the join."""
    joined = rows.withColumnsRenamed({"id": key}).join(spans, key)
    cut = F.substring(F.col("text").cast("binary"), (F.col(low) + 1).cast("int"), (F.col(high) - F.col(low)).cast("int"))
    return joined.withColumn(out, cut).drop("text", low, high)


def repeated_passages(docs: DataFrame, p: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, end_word, source_id, source_first, source_end, likeness): a row for each stretch of words of a
    document that an earlier one, by id, has too, `least` words or longer and `alike` or more. Of several earlier ones
    the first that has a seed counts for that seed.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; words are counted from 0. Null and empty texts and null ids have
    no passages. Rows of one id are taken for one document's: none of them is an earlier one of another. Other columns are not read; an empty
    table gives no rows. Ids are integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # read twice, for the first places and for the matches: hashing all words again would cost more than reading
    found = saved(_seed_rows(rows, p), "seeds")
    # sums are taken before rows move: a seed in all documents is one row a task; the order of a struct is that of its fields
    first = found.groupBy("seed").agg(F.min(F.struct("id", "pos", "low", "high")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that both sides of the join are plain exchanges: Spark then splits a seed that very many documents have
    first = saved(first.select("seed", F.col("first.id").alias("source"), F.col("first.pos").alias("place"), F.col("first.low").alias("low_there"), F.col("first.high").alias("high_there")), "first")
    match = F.struct("pos", "place", "low", "high", "low_there", "high_there")
    pairs = found.join(first, "seed").where("id <> source").groupBy("id", "source").agg(F.collect_list(match).alias("matches"))
    # of a passage of the least length, or of what its ends leave of it, seeds are this far apart at least
    short = max(p.words, p.least - 2 * (p.words + p.window))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, BATCH):
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            all_matches = np.column_stack([x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten()]).astype(np.int64)
            out = []
            for doc, source, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.split(all_matches, ends[:-1]), strict=True):
                bounds = {(i, j): rest for i, j, *rest in m.tolist()}
                for c in chains(list(bounds), p):
                    if c[-1][0] + p.words - c[0][0] >= short:
                        (low, _, low_there, _), (_, high, _, high_there) = bounds[c[0]], bounds[c[-1]]
                        out.append((doc, source, c[0][0], c[0][1], low, high, low_there, high_there, [x for m in c for x in m]))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            names = [x.split()[0] for x in SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:8]), pa.array(columns[8], pa.list_(pa.int64()))], names)

    spans = Saved(pairs.mapInArrow(chain, SPANS), "chains").df
    ours = _with_stretch(rows, spans, "here", "low", "high", "ours")
    both = _with_stretch(rows, ours, "there", "low_there", "high_there", "theirs").select("ours", "theirs", "here", "there", "a", "c", "chain")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, BATCH):
            ours, theirs, out = BatchWords(batch.column(0)), BatchWords(batch.column(1)), []
            for k, (here, there, a, c, chain) in enumerate(zip(*(x.to_pylist() for x in batch.columns[2:]), strict=True)):
                x, y = max(0, a - p.edge), max(0, c - p.edge)
                path = [(i - x, j - y) for i, j in zip(chain[::2], chain[1::2], strict=True)]
                for i, j, n, m, alike in aligned(ours.of(k), theirs.of(k), path, p):
                    out.append((here, i + x, j + x, there, n + y, m + y, alike))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if n == 6 else pa.int64()) for n, v in enumerate(columns)], FOUND)

    done = both.mapInArrow(verify, ", ".join(f"{c} {'double' if c == 'likeness' else 'bigint'}" for c in FOUND))
    return done.withColumnsRenamed({"id": id_col}).distinct()


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the passages' words taken out of the texts, each with the white space before it; other columns and rows
    without passages stay as they are. A row of null id or text stays as it is."""
    spans = passages.groupBy(F.col(id_col).alias("__id")).agg(F.collect_list(F.struct("first_word", "end_word")).alias("__spans"))
    joined = docs.join(spans, docs[id_col] == spans["__id"], "left").drop("__id")

    def cut(column: pa.Array, spans: list) -> list[str | None]:
        words = BatchWords(column)
        out = column.to_pylist()
        for i, found in enumerate(spans):
            if not found or out[i] is None:
                continue
            gone = np.zeros(words.bounds[i + 1] - words.bounds[i], bool)
            for s in found:
                gone[s["first_word"] : s["end_word"]] = True
            raw, keep = out[i].encode(), bytearray()
            at, base = 0, int(words.rows[i])
            for k in np.flatnonzero(gone).tolist():
                w = words.bounds[i] + k
                left = int(words.ends[w - 1]) - base if k else 0
                keep += raw[at : max(at, left)]
                at = int(words.ends[w]) - base
            keep += raw[at:]
            out[i] = keep.decode()
        return out

    names = docs.columns
    where, spans_at = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, where, BATCH):
            text = batch.column(where)
            done = pa.array(cut(text, batch.column(spans_at).to_pylist()), text.type)
            yield pa.RecordBatch.from_arrays([done if i == where else batch.column(i) for i in range(len(names))], names)

    return joined.mapInArrow(run, docs.schema)
