"""Tokens of whole texts under a byte-level vocabulary, each distinct word worked out once in a worker.

A byte-level pre-tokenizer starts a new piece at a single space before a word, and takes a single line feed between two
words as a piece of its own. So a text's tokens are those of its words, " word", or "word" at a line's start, one after
the other; a mark such as a comma after a word's last letter is a piece of its own too. A text with other white space at such a place is worked out whole."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from tradeframe.llm.words import BatchWords, mix

#: Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Words end at these alone.
BREAKS = np.isin(np.arange(256), [0x20, 0x0A])

#: What is added to a word's hash: it follows a space; starts a text, or is a mark at a word's end; follows a line feed.
PLACES = np.concatenate([[np.uint64(0)], mix(np.arange(7, 9))])


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the others, in order, for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, other = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in plain else other))
        other += b not in plain
    return letters


class WordTable:
    """Values of words by hash, as sorted arrays: `make` gives the numbers for one string that no white space cuts."""

    #: Words kept; then the table starts anew.
    MOST = 2_000_000

    def __init__(self, make: Callable[[str], list[int]], dtype: np.dtype):
        self.make, self.dtype = make, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool = np.empty(0, self.dtype)

    def add(self, keys: np.ndarray, words: list[tuple[str, str]]) -> None:
        """words: what stands before a word, and the word. A size of -1 marks a word that starts with white space."""
        values: list[int] = []
        size = np.empty(len(words), np.int32)
        for i, (lead, word) in enumerate(words):
            if word[0].isspace():
                size[i] = -1
                continue
            before = len(values)
            if lead == "\n":
                values += self.make("\n")
            values += self.make(" " + word if lead == " " else word)
            size[i] = len(values) - before
        held = np.maximum(size, 0)
        at = len(self.pool) + np.cumsum(held) - held
        self.pool = np.concatenate([self.pool, np.array(values, self.dtype)])
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.size = (np.insert(old, where, new[order]) for old, new in ((self.keys, keys), (self.at, at), (self.size, size)))

    def look_up(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a batch: each word's place in the pool and size, the first word of each row with the end, and which rows have to be worked out whole."""
        if len(self.keys) > self.MOST:
            self.clear()
        words = BatchWords(column, BREAKS, lower=False, marks=True)
        lead = np.where(words.starts > 0, words.raw[words.starts - 1], 0) if len(words.raw) else np.empty(0, np.uint8)
        place = np.where(lead == 0x0A, 2, 0)
        starting = words.bounds[:-1][words.bounds[1:] > words.bounds[:-1]]
        place[starting] = 1
        place[words.marked] = 1
        coded = pa.array(words.hashes + PLACES[place]).dictionary_encode()
        keys, which = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        found = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((found == len(self.keys)) | (self.keys[np.minimum(found, len(self.keys) - 1)] != keys if len(self.keys) else True))
        if len(new):
            leads = (" ", "", "\n")
            one, raw = first[new], words.raw.tobytes()
            spans = zip(place[one].tolist(), words.starts[one].tolist(), words.ends[one].tolist(), strict=True)
            self.add(keys[new], [(leads[k], raw[i:j].decode()) for k, i, j in spans])
            found = np.searchsorted(self.keys, keys)
        size = self.size[found][which]
        solid = np.concatenate([[0], np.cumsum(words.ends - words.starts)])[words.bounds]
        whole = np.concatenate([[0], np.cumsum(~words.marked)])[words.bounds]
        # each break stands alone between two words
        odd = (np.diff(words.rows) - np.diff(solid) != np.diff(whole) - 1) & (np.diff(words.rows) > 0)
        odd[np.searchsorted(words.bounds, np.flatnonzero(size < 0), "right") - 1] = True
        return self.at[found][which], np.maximum(size, 0), words.bounds, odd

    def sums(self, column: pa.Array, whole: Callable[[str], list[int]]) -> np.ndarray:
        """The sum of the numbers of each row's words."""
        at, size, bounds, odd = self.look_up(column)
        pool = np.concatenate([[0], np.cumsum(self.pool, dtype=np.int64)])
        running = np.concatenate([[0], np.cumsum(pool[at + size] - pool[at])])
        out = np.diff(running[bounds])
        for i in np.flatnonzero(odd):
            out[i] = sum(whole(column[int(i)].as_py()))
        return out

    def rows(self, column: pa.Array, whole: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all rows one after the other, and where each row starts, with the end."""
        at, size, bounds, odd = self.look_up(column)
        past = np.cumsum(size, dtype=np.int64)
        flat = self.pool[np.repeat(at - past + size, size) + np.arange(past[-1] if len(past) else 0)]
        ends = np.concatenate([[0], past])[bounds]
        if odd.any():
            parts = [flat[ends[i] : ends[i + 1]] if not odd[i] else np.array(whole(column[i].as_py()), self.dtype) for i in range(len(odd))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            flat = np.concatenate(parts)
        return flat, ends


class Encoder:
    """Ids by the tokenizers library. Its model gets each piece by itself, which spares it the offsets of whole texts."""

    #: Pieces kept beside the words.
    MOST = 200_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, list[int]] = {}
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.table = WordTable(self.word, np.dtype(np.uint16 if small else np.uint32))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids_of(self, piece: str) -> list[int]:
        return [x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.ids_of(piece)
            if len(self.pieces) >= self.MOST:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def word(self, text: str) -> list[int]:
        bare = text[1:] if text[0] == " " else text
        if bare.isalpha():
            if bare.isascii():  # ASCII letters stand for themselves
                return [x.id for x in self.model.tokenize(bare if bare is text else self.letters[0x20] + bare)]
            return self.ids_of(text)
        if any(x in text for x in self.added):
            return self.whole(text)
        return [i for p in PIECES.findall(text) for i in self.piece(p)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.table.rows(column, self.whole)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary file in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
