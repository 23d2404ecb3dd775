"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import over_batches
from tradeframe.llm.tokenizing import PIECES, WordTable, byte_letters

#: Bits of a symbol's number and of a place in a piece; a symbol that has merged into its left neighbour has the number NONE, which no pair has.
BITS, PLACE = 20, 32
SYMBOL, LAST, NONE = (1 << BITS) - 1, (1 << PLACE) - 1, (1 << BITS) - 1


class MergeCounter:
    """Tokens of a text under a byte-level BPE vocabulary (.json)."""

    #: Pieces kept beside the words.
    MOST = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number: dict[str, int] = {}
        of = lambda s: number.setdefault(s, len(number))
        self.first = [of(x) for x in byte_letters()]
        #: left symbol and right symbol -> rank and merged symbol, each two numbers in one
        self.merge = {of(a) << BITS | of(b): rank << BITS | of(a + b) for rank, (a, b) in enumerate(pairs)}
        added = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.seen: dict[str, int] = {}
        self.table = WordTable(self.whole, np.dtype(np.int32))

    def piece(self, piece: bytes) -> int:
        """Symbols less merges: pop the pair of lowest rank, the leftmost of equals, until no neighbours can merge."""
        symbols = [self.first[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return n
        merge = self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found >> BITS << PLACE | i for i in range(n - 1) if (found := merge(symbols[i] << BITS | symbols[i + 1]))]
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i = top & LAST
            j = after[i]
            if j >= n or not (found := merge(symbols[i] << BITS | symbols[j])) or found >> BITS != top >> PLACE:
                continue  # one of the two has merged meanwhile
            new = found & SYMBOL
            symbols[i], symbols[j] = new, NONE
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merge(new << BITS | symbols[k]):
                    heappush(heap, found >> BITS << PLACE | i)
            h = before[i]
            if h >= 0 and (found := merge(symbols[h] << BITS | new)):
                heappush(heap, found >> BITS << PLACE | h)
        return left

    def known(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = self.piece(piece.encode())
            if len(self.seen) >= self.MOST:
                self.seen.clear()
            self.seen[piece] = n
        return n

    def whole(self, text: str) -> list[int]:
        """One number: the tokens of a string."""
        if (text[1:] if text[:1] == " " else text).isalpha():
            return [self.piece(text.encode())]
        if self.added is None:
            return [sum(map(self.known, PIECES.findall(text)))]
        parts = self.added.split(text)
        return [len(parts) - 1 + sum(self.known(p) for part in parts for p in PIECES.findall(part))]

    def count(self, column: pa.Array) -> np.ndarray:
        return self.table.sums(column, self.whole)


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, in one pass without a shuffle.

    vocabulary: path of a byte-level BPE .json file, the same on all machines. Strings of added tokens inside a text
    count as one token each. A null text counts as empty: no bytes and no tokens; a null id stays null; repeated rows
    each have their row; other columns are not read; an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(vocabulary).count(batch.column(1))
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0)
        return pa.RecordBatch.from_arrays([batch.column(0), size.cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = over_batches(rows, step, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
