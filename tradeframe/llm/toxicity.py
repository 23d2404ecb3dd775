"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, and votes weighted by distance.

Terms are words and beginnings of words, and all of an example's terms are in its vector. A term's weight is its TF-IDF
times its relevance: 1 where its presence goes clearly with one of the labels (log-likelihood ratio, and how many times
as often within the one label as within the other: neither depends on the labels' shares), FLOOR where it doesn't."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import Saved, over_batches, small_batches
from tradeframe.llm.words import BETWEEN, LOWER, BatchWords, prefix_hashes

#: Beginnings that are terms, in bytes.
PREFIXES = (4, 5)

#: Examples in a block.
BLOCK = 64

#: Blocks scored before the others' bounds are held against the k-th nearest.
FEW = 2

#: Bytes of texts whose terms are found at once: an occurrence takes some fifty bytes for a while.
BATCH = 1 << 20

#: Relevance of a term that says nothing about the label.
FLOOR = 0.05


def term_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every occurrence of a term."""
    words = BatchWords(column, BETWEEN)
    row = np.repeat(np.arange(len(words)), np.diff(words.bounds))
    raw = LOWER[words.raw]
    rows, terms = [row], [words.hashes]
    for size in PREFIXES:
        hashes = prefix_hashes(words, raw, size)
        rows.append(row[hashes > 0])
        terms.append(hashes[hashes > 0])
    return np.concatenate(rows), np.concatenate(terms)


def counted(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) in that order, and how often each occurs."""
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])]) if len(rows) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return rows[at], terms[at], np.diff(np.concatenate([at, [len(rows)]]))


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[0], ..., end[0] - 1, first[1], ...; and how many of each."""
    size = end - first
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size), size


@dataclass
class Examples:
    """Unit vectors of labelled rows, dealt into blocks, as inverted lists: a term's postings are ordered by example, and
    those of one block are a run, with the greatest of their weights."""

    terms: np.ndarray
    weight: np.ndarray
    prior: float
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: per example: labelled rows that it stands for
    stands: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: per posting
    example: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: per run: its block, greatest weight, and first posting, with the end
    block: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    top: np.ndarray = field(default_factory=lambda: np.empty(0))
    posting: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    #: per term: its first run, with the end
    run: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, weight), rows of length one, ordered by row."""
        rows, terms = term_rows(column)
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        return self.unit(*counted(rows[known], at[known]), len(column))

    def unit(self, rows: np.ndarray, at: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = (1 + np.log(n)) * self.weight[at]
        norm = np.sqrt(np.bincount(rows, weight**2, size))
        return rows, at, weight / norm[rows]

    def build(self, ids: list, labels: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """From the vectors of the examples, ordered by example."""
        self.ids, self.labels = ids, labels
        order = np.lexsort((rows, terms))
        terms, self.example, self.value = terms[order], rows[order].astype(np.int32), weights[order]
        block = self.example // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.block = block[at]
        self.posting = np.append(at, len(terms))
        self.top = np.maximum.reduceat(self.value, at) if len(at) else np.empty(0)
        self.run = np.searchsorted(terms[at], np.arange(len(self.terms) + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of greatest cosine above 0, (cosine, number), exactly; of equal ones, those of least number.

        A block's bound adds the greatest weight that each term has there. The blocks of highest bounds are scored, then
        those of the others that may still hold one of the k."""
        runs, many = ranges(self.run[terms], self.run[terms + 1])
        q, block = np.repeat(weights, many), self.block[runs]
        n_blocks = -(-len(self.ids) // BLOCK)
        bound = np.bincount(block, q * self.top[runs], n_blocks)
        score, seen, least = np.zeros(len(self.ids)), np.zeros(n_blocks, bool), 0.0
        for first in (True, False):
            # of a block that can only draw level, all but rounding may be the better
            want = (bound > 0) & ~seen & (bound >= least - 1e-11)
            if first and n_blocks > FEW:
                some = np.zeros(n_blocks, bool)
                some[np.argpartition(-bound, FEW)[:FEW]] = True
                want &= some
            if not want.any():
                continue
            here = want[block]
            postings, size = ranges(self.posting[runs[here]], self.posting[runs[here] + 1])
            score += np.bincount(self.example[postings], np.repeat(q[here], size) * self.value[postings], len(score))
            seen |= want
            least = float(np.partition(score, -k)[-k]) if len(score) > k else 0.0
        some = np.flatnonzero((score > 0) & (score >= least - 1e-11))
        return sorted(((round(float(score[x]), 12), x) for x in some.tolist()), key=lambda x: (-x[0], x[1]))[:k]


def log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """G squared of a term's presence against the label."""
    total = 0.0
    n = n_toxic + n_clean
    for seen, size in ((toxic, n_toxic), (clean, n_clean)):
        for have, all_have in ((seen, toxic + clean), (size - seen, n - toxic - clean)):
            expected = all_have * size / n
            total = total + np.where(have > 0, 2 * have * np.log(np.maximum(have, 1) / np.maximum(expected, 1e-9)), 0)
    return total


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """From FLOOR to 1, of terms in so many rows of either label."""
    sure = np.clip((log_ratio(toxic, clean, n_toxic, n_clean) - 10) / 10, 0, 1)
    rates = np.array([(toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)])
    times = np.clip(np.log(rates.max(axis=0) / rates.min(axis=0)) / np.log(3), 0, 1)
    return FLOOR + (1 - FLOOR) * sure * times


def _learnt(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int) -> tuple[Saved, DataFrame, list, dict]:
    """A saved table; (id, text, label) of the rows of it to learn from; (id, label) of each in the order of choice; labelled ids in all, by label."""
    # one row an id: the greater label where two differ
    rows = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    labelled = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = [r for y in (0, 1) for r in rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most // 2).collect()]
    sample = docs.sparkSession.createDataFrame([(r.id, r.label) for r in chosen], "id bigint, label int")
    found = docs.join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))
    kept_rows = Saved(found, "train")
    train = kept_rows.df
    size = {r.id: r.size for r in train.select("id", F.octet_length("text").alias("size")).collect()}
    kept, left = [], {0: most_bytes // 2, 1: most_bytes // 2}
    for r in chosen:
        if size.get(r.id, most_bytes) <= left[r.label]:
            left[r.label] -= size[r.id]
            kept.append((r.id, r.label))
    some = docs.sparkSession.createDataFrame(kept, "id bigint, label int").select("id")
    return kept_rows, train.join(F.broadcast(some), "id"), kept, labelled


def fit(docs: DataFrame, labels: DataFrame, most: int = 16_000, most_bytes: int = 128 << 20, most_examples: int = 1_024) -> Examples:
    """Fit on labelled rows (id, label 0/1) of docs (id, text): `most` of them and `most_bytes` of text, half of each
    label at most, chosen by a hash of the id, give the terms' relevance; the first `most_examples` of those, half of each
    label, are the examples. So what is sent to the machines has a bounded size whatever the table's. Where a label has
    more rows than examples, each of these stands for several in votes."""
    rows_kept, train, chosen, labelled = _learnt(docs, labels, most, most_bytes)
    n_all, n_toxic = len(chosen), sum(y for _, y in chosen)
    total = {y: max(labelled.get(y, 0), 0) if any(c == y for _, c in chosen) else 0 for y in (0, 1)}
    prior = (total[1] + 0.5) / (total[0] + total[1] + 1)
    if not n_all:
        rows_kept.drop()
        return Examples(np.empty(0, np.uint64), np.empty(0), prior)
    spark = docs.sparkSession
    label = dict(x for y in (0, 1) for x in [c for c in chosen if c[1] == y][: most_examples // 2])
    some = spark.createDataFrame([(i,) for i in label], "id bigint")

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, terms, n = counted(*term_rows(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(terms.view(np.int64)), pa.array(n, pa.int32())], ["id", "term", "n"])

    # of rows and bytes that are bounded
    vectors = over_batches(train.join(F.broadcast(some), "id").select("id", "text"), own, "id bigint, term bigint, n int", most=BATCH).toArrow()
    ids, term, many = (vectors[c].to_numpy() for c in ("id", "term", "n"))
    terms, at = np.unique(term.view(np.uint64), return_inverse=True)
    del vectors, term
    sent = spark.sparkContext.broadcast(terms)

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = sent.value
        rows, found, _ = counted(*term_rows(batch.column(1)))
        place = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
        good = known[place] == found if len(known) else np.zeros(len(found), bool)
        toxic = batch.column(2).to_numpy(zero_copy_only=False)[rows[good]]
        n, y = np.bincount(place[good], minlength=len(known)), np.bincount(place[good], toxic, len(known))
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(y[at].astype(np.int64))], ["term", "n", "toxic"])

    per_term = over_batches(train.select("id", "text", "label"), stats, "term bigint, n bigint, toxic bigint", most=BATCH)
    frame = per_term.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    # nothing reads the texts again
    rows_kept.drop()
    n, toxic = np.zeros((2, len(terms)))
    place = frame["term"].to_numpy()
    n[place], toxic[place] = frame["n"].to_numpy(), frame["toxic"].to_numpy()
    idf = np.log((1 + n_all) / (1 + n)) + 1
    model = Examples(terms, idf * relevance(toxic, n - toxic, n_toxic, n_all - n_toxic), prior)
    ids, row = np.unique(ids, return_inverse=True)
    order = np.lexsort((at, row))
    row, at, weight = model.unit(row[order], at[order], many[order], len(ids))
    # rows of one strongest term next to each other: blocks hold like rows, and their bounds are near their best
    first = np.searchsorted(row, np.arange(len(ids)))
    heavy = np.lexsort((at, -weight, row))[first]
    by = np.lexsort((ids, -weight[heavy], at[heavy]))
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    order = np.lexsort((at, place[row]))
    named = [int(x) for x in ids[by]]
    model.build(named, np.array([label[x] for x in named], float), place[row][order], at[order], weight[order])
    rows_of = np.array([sum(1 for y in label.values() if y == c) for c in (0, 1)])
    stands = np.array([total[c] / max(rows_of[c], 1) for c in (0, 1)])
    model.stands = stands[model.labels.astype(int)] if named else np.empty(0)
    return model


#: Weight of the share of toxic rows among all, in units of a neighbour of cosine 1.
PRIOR_WEIGHT = 0.5

#: Vectors whose answers a task remembers: copies are looked up once.
REMEMBERED = 20_000


def score(docs: DataFrame, model: Examples, k: int = 15) -> DataFrame:
    """(id, score, evidence) of each row of docs (id, text): the nearest examples vote, each with its cosine squared times the
    rows it stands for, against the share of toxic rows among all; evidence lists the three nearest. Rows without a term of
    the model get that share."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["id"].dataType.simpleString()
    evidence = pa.list_(pa.struct([("id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def answer(model: Examples, terms: np.ndarray, weights: np.ndarray) -> tuple[float, list]:
        near = model.nearest(terms, weights, k)
        votes = sum(s * s * model.stands[e] for s, e in near)
        yes = sum(s * s * model.stands[e] * model.labels[e] for s, e in near)
        why = [{"id": model.ids[e], "similarity": s, "toxic": int(model.labels[e])} for s, e in near[:3]]
        return float((yes + PRIOR_WEIGHT * model.prior) / (votes + PRIOR_WEIGHT)), why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen: dict[bytes, tuple[float, list]] = {}
        for batch in small_batches(batches, most=BATCH):
            rows, at, weight = model.vectors(batch.column(1))
            scores, why = np.full(batch.num_rows, model.prior), [[] for _ in range(batch.num_rows)]
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1)).tolist()
            for row, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                if i == j:
                    continue
                key = xxhash.xxh3_128_digest(at[i:j].tobytes() + weight[i:j].tobytes())
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = answer(model, at[i:j], weight[i:j])
                scores[row], why[row] = seen[key]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(why, evidence)], ["id", "score", "evidence"])

    return docs.mapInArrow(run, f"id {kind}, score double, evidence array<struct<id bigint, similarity double, toxic int>>")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, evidence) of each row of docs.

    Learns from labels whose crc32(id as text) mod `folds` is not `held_out` (None: from all), and from the texts
    alone. A null or empty text is scored as one without known terms; a null id stays null and is not held out; null
    labels and labels other than 0 and 1 are not learnt from; of unlike labels of one id the greater counts; repeated
    rows each have their row; other columns are not read; an empty docs table gives no rows, and without labels all
    scores are one half."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == F.lit(held_out), F.lit(False)) if held_out is not None else F.lit(False)
    learn = labels.where(~fold).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = score(rows, fit(rows, learn))
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == F.lit(held_out), F.lit(False)) if held_out is not None else F.lit(False)
    return scored.select(F.col("id").alias(id_col), fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
