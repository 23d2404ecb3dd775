"""Benchmark items found in documents by template: numbers, names and units become typed placeholders, windows of
template words are joined, and what stands in the placeholders must correspond throughout."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import small_batches
from tradeframe.llm.words import BETWEEN, BatchWords, mix, window_hashes

#: Words of units, in lower case.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres dollar dollars cent cents euro euros percent degree degrees mph kph hz khz mhz ghz kb mb gb tb w kw kwh v j cal kcal"
).split()

NUMBER, NAME, UNIT = 1, 2, 3

#: A bound on the windows of a benchmark that are sent to all machines; with more, the windows of documents are joined with them.
SENT = 4_000_000


def _unit_hashes() -> np.ndarray:
    return np.sort(BatchWords(pa.array([" ".join(UNITS)])).hashes)


_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


_JOINS = np.isin(np.arange(256), list(b".,"))


class Templates:
    """values: hash of each word of a batch in lower case; bounds: each row's first word, with the end; and kinds of each
    word, 0 for one that stands for itself: in `plain` numbers and units are placeholders, in `wide` words with a
    capital are too.

    A number goes on over a mark between digits: 12.50 and 1,250 are one word. Which words are names is seldom sure, at the
    beginning of a sentence or in lower case: texts are held against each other in both ways."""

    def __init__(self, column: pa.Array, units: np.ndarray):
        w = BatchWords(column, BETWEEN)
        raw, n = w.raw, len(w.starts)
        self.values, self.bounds = w.hashes, w.bounds
        self.plain, self.wide = np.zeros((2, n), np.uint8)
        if not n:
            return
        first = np.zeros(n, bool)
        first[w.bounds[:-1][w.bounds[1:] > w.bounds[:-1]]] = True
        head = raw[w.starts]
        number = _DIGIT[head]
        # a capital, then a small letter
        name = _UPPER[head] & ~_UPPER[raw[np.minimum(w.starts + 1, w.ends - 1)]] & (w.ends - w.starts > 1)
        at = np.minimum(np.searchsorted(units, w.hashes), len(units) - 1)
        unit = (units[at] == w.hashes) & np.concatenate([[False], number[:-1]]) & ~first
        self.plain[number], self.plain[unit] = NUMBER, UNIT
        self.wide[name], self.wide[number], self.wide[unit] = NAME, NUMBER, UNIT
        before = np.concatenate([[0], w.ends[:-1]])
        more = number & np.concatenate([[False], _DIGIT[raw[w.ends[:-1] - 1]]]) & (w.starts - before == 1) & _JOINS[raw[np.maximum(w.starts - 1, 0)]] & ~first
        if more.any():
            start = np.flatnonzero(~more)
            nth = np.arange(n) - start[np.cumsum(~more) - 1]
            self.values = np.add.reduceat(self.values * (2 * nth + 1).astype(np.uint64), start)
            self.plain, self.wide = self.plain[start], self.wide[start]
            self.bounds = np.searchsorted(start, self.bounds)

    def windows(self, width: int, literal: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, hashes, kinds of all words) of the windows, in each way that a text is read. A window of fewer than two
        words that stand for themselves, as in a table of numbers, says nothing as a template: it is taken word for word,
        and so are all if `literal`."""
        n = max(0, len(self.values) - width + 1)
        none = np.zeros(len(self.values), np.uint8)
        free = lambda kinds: np.convolve(kinds == 0, np.ones(width, np.int64), "valid")[:n] if n else np.zeros(0, np.int64)
        of = lambda kinds: window_hashes(np.where(kinds > 0, mix(kinds + np.uint64(77)), self.values), width)
        free_plain = free(self.plain)
        some = np.flatnonzero((free_plain < 2) | literal)
        if len(some):
            yield some, mix(window_hashes(self.values, width) + np.uint64(1))[some], none
        if not literal:
            some = np.flatnonzero(free_plain >= 2)
            yield some, of(self.plain)[some], self.plain
            free_wide = free(self.wide)
            some = np.flatnonzero((free_wide >= 2) & (free_wide < free_plain))
            yield some, of(self.wide)[some], self.wide


def _window_frame(rows: DataFrame, widths: list[int], least: int, of_items: bool, kept=None) -> DataFrame:
    """(id, hash, width, pos, size, words, kinds) of the windows of each row: all of them, or those whose hash `kept` holds.

    of_items: a window narrower than the widest is only that of a row that has no more words."""
    widest = max(widths)
    units = _unit_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            t = Templates(batch.column(1), units)
            bounds, value, parts = t.bounds, t.values.tobytes(), []
            for width in widths:
                for at, hashes, kinds in t.windows(width, width < least):
                    if kept is not None:
                        known = kept.value
                        found = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                        good = known[found] == hashes if len(known) else np.zeros(len(hashes), bool)
                        at, hashes = at[good], hashes[good]
                    row = np.searchsorted(bounds, at, "right") - 1
                    good = at + width <= bounds[row + 1]
                    if of_items and width < widest:
                        good &= bounds[row + 1] - bounds[row] == width
                    at, kind = at[good], kinds.tobytes()
                    parts.append((row[good], hashes[good], np.full(len(at), width), at, [kind[i : i + width] for i in at.tolist()]))
            row, hashes, width, at = (np.concatenate([p[i] for p in parts]) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(hashes.view(np.int64)),
                    pa.array(width, pa.int32()),
                    pa.array(at - bounds[row], pa.int64()),
                    pa.array(bounds[row + 1] - bounds[row], pa.int64()),
                    pa.array([value[8 * i : 8 * (i + w)] for i, w in zip(at.tolist(), width.tolist(), strict=True)], pa.binary()),
                    pa.array([k for p in parts for k in p[4]], pa.binary()),
                ],
                ["id", "hash", "width", "pos", "size", "words", "kinds"],
            )

    return rows.mapInArrow(run, "id bigint, hash bigint, width int, pos bigint, size bigint, words binary, kinds binary")


def consistent(windows: list[tuple], size: int) -> tuple[set[int], int, int, bool]:
    """Of the common windows of a document and an item, (pos, item pos, width, item's words, document's words, kinds):
    the item's words covered by those that agree, the passage in the document, and whether all words are the same.

    Windows of one shift between the two texts make a start, the commonest first; those of other shifts, `size` at most
    from it, go on from there where both texts are in the same order: words put in or left out change the shift. A
    placeholder's word in the item always goes with one word in the document, and the other way round; a window that
    breaks this is left out."""
    by: dict[int, list[tuple]] = {}
    for x in sorted(set(windows)):
        by.setdefault(x[0] - x[1], []).append(x)
    order = sorted(by, key=lambda s: (-len(by[s]), s))
    best: tuple[set[int], int, int, bool] = (set(), 0, 0, False)
    for start in order:
        near = [s for s in order if abs(s - start) <= size]
        if len(best[0]) >= min(size, sum(x[2] for s in near for x in by[s])):
            continue
        there: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], int] = {}
        covered, path, same = set(), [], True
        for shift in [start, *(s for s in near if s != start)]:
            for p, q, width, item, doc, kinds in by[shift]:
                at = bisect_left(path, (q, p))
                if at < len(path) and path[at] != (q, p) and (path[at][0] == q or path[at][1] <= p) or at and (path[at - 1][0] == q and path[at - 1] != (q, p) or path[at - 1][1] >= p):
                    continue
                a, b = np.frombuffer(item, np.uint64).tolist(), np.frombuffer(doc, np.uint64).tolist()
                slots = [(k, x, y) for k, x, y in zip(kinds, a, b, strict=True) if k]
                if not all(there.get((k, x), y) == y and back.get((k, y), x) == x for k, x, y in slots):
                    continue
                there |= {(k, x): y for k, x, y in slots}
                back |= {(k, y): x for k, x, y in slots}
                covered.update(range(q, q + width))
                same &= a == b
                if at == len(path) or path[at] != (q, p):
                    path.insert(at, (q, p))
        if len(covered) > len(best[0]):
            widths = {(x[1], x[0]): x[2] for s in near for x in by[s]}
            best = (covered, min(p for _, p in path), max(p + widths[q, p] for q, p in path), same)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, coverage, first_word, end_word, exact): a row for each document and benchmark item whose words, in
    template form, the document has for `coverage` of the item or more, in windows of `width` words with corresponding
    numbers, names and units. Words are runs of letters and digits; case and marks between words don't matter.

    An item of fewer than `width` words is one window; one of fewer than `least` words is looked for word for word, as
    are windows with hardly a word beside placeholders. Items without a word are in no pair. Null ids and null or empty texts are in no pair; repeated rows of a document or an item count once; other
    columns are not read; an empty table on either side gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text")).where("id is not null and text is not null")
    widths = [width, *range(1, width)]
    sought = _window_frame(items, widths, least, True)
    known = sought.select("hash").distinct()
    kept = None
    # one more than the bound tells which way to take
    some = known.limit(SENT + 1).toPandas()["hash"].to_numpy(np.int64)
    if len(some) <= SENT:
        kept = spark.sparkContext.broadcast(np.sort(some.view(np.uint64)))
    # of narrow windows only those that are a whole item
    there = sorted({r["width"] for r in sought.select("width").distinct().collect()}, reverse=True) or [width]
    found = _window_frame(rows, there, least, False, kept).select("id", "hash", "width", "pos", F.col("words").alias("doc_words"))
    sought = sought.select(F.col("id").alias("item"), "hash", "width", F.col("pos").alias("item_pos"), "size", "words", "kinds").dropDuplicates(["item", "hash", "width", "item_pos", "words"])
    both = found.join(sought, ["hash", "width"])
    grouped = both.groupBy("id", "item").agg(F.max("size").alias("size"), F.collect_set(F.struct("pos", "item_pos", "width", "words", "doc_words", "kinds")).alias("windows"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            out = []
            for doc, item, size, windows in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                covered, low, high, same = consistent([tuple(x.values()) for x in windows], size)
                if len(covered) >= coverage * size:
                    out.append((doc, item, len(covered) / size, low, high, same))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["id", "item", "coverage", "first_word", "end_word", "exact"])

    done = grouped.mapInArrow(verify, "id bigint, item bigint, coverage double, first_word bigint, end_word bigint, exact boolean")
    return done.withColumnsRenamed({"id": id_col, "item": item_col})
