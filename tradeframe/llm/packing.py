"""Documents packed into training sequences by cost: linear in a piece's tokens, plus quadratic attention within the piece."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import small_batches
from tradeframe.llm.tokenizing import encoder

#: Cost of a piece of n tokens: n + QUADRATIC * n * n, in token units.
QUADRATIC = 1 / 2048


def cost(n: int) -> float:
    return n + QUADRATIC * n * n


def balance(sizes: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pack pieces into as many full sequences as their tokens fill. Pieces, all shorter than the capacity, go in
    descending order to the sequence of least cost that has room left; what exceeds its room is cut off and takes its
    turn again. Returns the full sequences, as lists of (piece, start, length), and the same for what is left over:
    fewer tokens than one sequence."""
    bins = sum(sizes) // capacity
    left = sum(sizes) - bins * capacity
    # cut the overhang from the shortest pieces; whole ones as far as it reaches
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    over: list[tuple[int, int, int]] = []
    keep = dict(enumerate(sizes))
    for i in reversed(order):
        if not left:
            break
        n = min(left, sizes[i])
        keep[i] -= n
        left -= n
        over.append((i, keep[i], n))
    todo = [(-keep[i], i, 0) for i in order if keep[i]]
    heapify(todo)
    open_bins = [(0.0, b) for b in range(bins)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    room = [capacity] * bins
    while todo:
        size, i, start = heappop(todo)
        spent, b = heappop(open_bins)
        n = min(-size, room[b])
        out[b].append((i, start, n))
        room[b] -= n
        if room[b]:
            heappush(open_bins, (spent + cost(n), b))
        if n < -size:
            heappush(todo, (size + n, i, start + n))
    return out, over


class Packer:
    """Packs the documents of one task, in rounds of bounded size."""

    #: Remainders gathered for a round, in tokens.
    ROUND = 1 << 21

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.held: list[tuple[object, int, int, np.ndarray]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple[object, int, int, np.ndarray]]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(doc, start, len(ids), ids[start : start + self.capacity])])
        if whole < len(ids):
            self.held.append((doc, whole, len(ids), ids[whole:]))
            self.tokens += len(ids) - whole
        if self.tokens >= self.ROUND:
            self.round()

    def _cut(self, part: tuple[int, int, int]) -> tuple[object, int, int, np.ndarray]:
        i, start, n = part
        doc, at, total, ids = self.held[i]
        return doc, at + start, total, ids[start : start + n]

    def round(self) -> None:
        full, over = balance([len(x[3]) for x in self.held], self.capacity)
        for pieces in full:
            self._emit([self._cut(x) for x in pieces])
        self.held = [self._cut(x) for x in over]
        self.tokens = sum(len(x[3]) for x in self.held)

    def end(self) -> None:
        """The last tokens, fewer than a sequence, go into sequences whose lengths are powers of two: no padding."""
        self.round()
        rest = self.held[::-1]
        size = 1 << (self.capacity.bit_length() - 1)
        left = self.tokens
        while left:
            while size > left:
                size >>= 1
            taken, room = [], size
            while room:
                doc, at, total, ids = rest.pop()
                taken.append((doc, at, total, ids[:room]))
                if len(ids) > room:
                    rest.append((doc, at + room, total, ids[room:]))
                room -= len(taken[-1][3])
            self._emit(taken)
            left -= size
        self.held, self.tokens = [], 0


SCHEMA = "id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the documents it reads, in rounds of bounded size, without a shuffle: whole stretches of `capacity`
    ids are sequences of their own, remainders are balanced by cost. A sequence's id is the task's number and a count.
    A null text is empty: the end id alone; a null id stays null; repeated rows are packed each; other columns are not
    read; an empty table gives no rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        types: list[pa.DataType] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        for batch in small_batches(batches):
            types = [batch.column(0).type, *[pa.int64()] * 6]
            flat, at = codes.encode(batch.column(1))
            flat = np.insert(flat.astype(np.uint32), at[1:], end_id)
            ends = (at[1:] + np.arange(1, len(at))).tolist()
            for doc, start, end in zip(batch.column(0).to_pylist(), [0, *ends], ends, strict=False):
                packer.add(doc, flat[start:end])
            yield rows()
        if types:
            packer.end()
            yield rows()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
