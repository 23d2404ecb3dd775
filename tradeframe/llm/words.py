"""Words of a batch of texts as 64-bit hashes, found with array operations over the batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed by array operations; a longer word is hashed by itself.
LONG = 48

#: `[\x20\x09-\x0D]`.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

#: A-Z become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A random odd factor for each place of a byte, and one for the length.
FACTORS = mix(np.arange(1, LONG + 2)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts in them, with the end. Null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


#: `[A-Za-z]`, and marks that end words of their own when they follow one of these.
LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
MARK = np.isin(np.arange(256), list(b".,!?;:"))


class BatchWords:
    """raw: bytes of all rows; starts, ends: of each word in raw; hashes: of each word; bounds: the first word of each row, with the end.

    marks: a single mark after a letter at a word's end is a word of its own; `marked` tells which words are such marks."""

    def __init__(self, column: pa.Array, white: np.ndarray = WHITE, lower: bool = True, marks: bool = False):
        self.raw, self.rows = text_bytes(column)
        raw = LOWER[self.raw] if lower else self.raw
        solid = ~white[self.raw]
        n = len(solid)
        first = np.zeros(n + 1, bool)
        first[self.rows] = True
        before = np.concatenate([[False], solid])[:n]
        behind = np.concatenate([solid[1:], [False]])[:n]
        self.starts = np.flatnonzero(solid & (~before | first[:n]))
        self.ends = np.flatnonzero(solid & (~behind | first[1:])) + 1
        if marks:
            self._part(raw)
        self.bounds = np.searchsorted(self.starts, self.rows)
        self.hashes = self._hash(raw)

    def _part(self, raw: np.ndarray) -> None:
        cut = (self.ends - self.starts > 1) & MARK[raw[self.ends - 1]] & LETTER[raw[self.ends - 2]]
        place = np.arange(len(cut)) + np.cumsum(cut) - cut
        starts, ends = np.empty((2, len(cut) + int(cut.sum())), np.int64)
        self.marked = np.zeros(len(starts), bool)
        self.marked[place[cut] + 1] = True
        starts[place], ends[place] = self.starts, self.ends - cut
        starts[self.marked], ends[self.marked] = self.ends[cut] - 1, self.ends[cut]
        self.starts, self.ends = starts, ends

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        size = self.ends - self.starts
        out = size.astype(np.uint64) * FACTORS[LONG]
        at, who = self.starts, np.arange(len(size))
        for k in range(min(LONG, int(size.max(initial=0)))):
            if k:
                more = size > k
                at, who, size = at[more], who[more], size[more]
            out[who] += (raw[at + k].astype(np.uint64) + np.uint64(1)) * FACTORS[k]
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            out[i] = xxhash.xxh3_64_intdigest(raw[self.starts[i] : self.ends[i]].tobytes())
        return mix(out)

    def __len__(self) -> int:
        return len(self.rows) - 1

    def of(self, row: int) -> np.ndarray:
        """A row's word hashes, in order."""
        return self.hashes[self.bounds[row] : self.bounds[row + 1]]

    def word(self, i: int) -> bytes:
        """As it stands in the text."""
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` neighbours, in order."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n]
        out *= FACTORS[0]
        out ^= out >> np.uint64(31)
    return mix(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a row's word shingles; with fewer words than `width` the whole sequence is one; without words there is none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, min(width, len(hashes))))


#: All but letters, digits and bytes of other scripts.
BETWEEN = ~(LETTER | np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x80, 0x100)]))


def prefix_hashes(words: BatchWords, raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first `size` bytes of each word; 0 for shorter words."""
    at = np.flatnonzero(words.ends - words.starts >= size)
    part = np.full(len(at), FACTORS[LONG] + np.uint64(size), np.uint64)
    for k in range(size):
        part += (raw[words.starts[at] + k].astype(np.uint64) + np.uint64(1)) * FACTORS[k]
    out = np.zeros(len(words.starts), np.uint64)
    out[at] = mix(part) | np.uint64(1)
    return out
