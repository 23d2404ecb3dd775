"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other, in blocks of 256. Of each block it stores the least id,
the other ids less that in as many bits as nine tenths of the block need, and the rest, the exceptions, in a list of
places and high bits. Layout, little-endian throughout:

    magic "TFPF" u32 | version u32 | block length u32 | blocks u32 | ids u64 | documents u64
    blocks, each: width u8 | 0 u8 | exceptions u16 | least id u32 | bit planes, low to high, 32 bytes each
                  | exceptions' places u8 | exceptions' high parts u32
    index:     start of each block in the file, u64
    documents: has an id u8 each | id i64 each | number of ids u32 each
    footer:    start of the index u64
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.llm.shared import BATCH_BYTES, small_batches
from tradeframe.llm.tokenizing import encoder

MAGIC, VERSION, BLOCK = b"TFPF", 1, 256
HEAD = struct.Struct("<4sIIIQQ")
BLOCK_HEAD = np.dtype([("width", "u1"), ("zero", "u1"), ("exceptions", "<u2"), ("least", "<u4")])

#: The share of a block's ids that the chosen width holds.
WITHIN = 0.9


def pack(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Blocks as bytes, and the size of each. The last block repeats its last id up to the block's length."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return [], np.empty(0, np.int64)
    full = np.concatenate([ids, np.repeat(ids[-1:], count * BLOCK - len(ids))]).astype(np.uint32).reshape(count, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    # bits that a number needs: 0 for 0; exact, as a double holds any of them
    need = np.frexp(rest.astype(np.float64))[1]
    width = np.sort(need, axis=1)[:, int(np.ceil(BLOCK * WITHIN)) - 1]
    over = need > width[:, None]
    head = np.zeros(count, BLOCK_HEAD)
    head["width"], head["exceptions"], head["least"] = width, over.sum(axis=1), least
    planes: dict[int, dict[int, bytes]] = {}
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        bits = np.stack([np.packbits((rest[which] >> np.uint32(k) & np.uint32(1)).astype(np.uint8), axis=1) for k in range(w)], axis=1) if w else np.empty((len(which), 0, BLOCK // 8), np.uint8)
        planes[w] = dict(zip(which.tolist(), bits.reshape(len(which), -1), strict=True))
    place = np.broadcast_to(np.arange(BLOCK, dtype=np.uint8), full.shape)[over]
    high = (rest >> width[:, None].astype(np.uint32))[over].astype("<u4")
    ends = np.cumsum(head["exceptions"].astype(np.int64))
    out = []
    for i, (w, e) in enumerate(zip(width.tolist(), ends.tolist(), strict=True)):
        b = e - int(head["exceptions"][i])
        out.append(head[i].tobytes() + planes[w][i].tobytes() + place[b:e].tobytes() + high[b:e].tobytes())
    return out, np.array([len(x) for x in out], np.int64)


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at `starts`, as one array."""
    heads = data[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD)[:, 0] if len(starts) else np.empty(0, BLOCK_HEAD)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    body = starts + BLOCK_HEAD.itemsize
    for w in np.unique(heads["width"]).tolist():
        which = np.flatnonzero(heads["width"] == w)
        for k in range(w):
            plane = data[(body[which] + k * BLOCK // 8)[:, None] + np.arange(BLOCK // 8)]
            out[which] |= np.unpackbits(plane, axis=1).astype(np.uint32) << np.uint32(k)
    number = heads["exceptions"].astype(np.int64)
    block = np.repeat(np.arange(len(starts)), number)
    nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    lists = body + heads["width"].astype(np.int64) * (BLOCK // 8)
    place = data[lists[block] + nth]
    high = data[(lists[block] + number[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(block) else np.empty(0, np.uint32)
    out[block, place] |= high << heads["width"][block].astype(np.uint32)
    out += heads["least"][:, None]
    return out.reshape(-1)


class FileWriter:
    """Builds one file in memory, packing whole blocks as they fill."""

    def __init__(self):
        self.blocks, self.sizes, self.rest = [], [], np.empty(0, np.uint32)
        self.ids, self.lengths, self.total, self.size = [], [], 0, 0

    def add(self, ids: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.ids += ids
        self.lengths.append(lengths)
        self.total += len(flat)
        flat = np.concatenate([self.rest, flat])
        whole = len(flat) // BLOCK * BLOCK
        self._pack(flat[:whole])
        self.rest = flat[whole:]

    def _pack(self, ids: np.ndarray) -> None:
        blocks, sizes = pack(ids)
        self.blocks += blocks
        self.sizes.append(sizes)
        self.size += int(sizes.sum())

    def close(self) -> bytes:
        self._pack(self.rest)
        sizes = np.concatenate(self.sizes)
        starts = HEAD.size + np.cumsum(sizes) - sizes
        known = np.array([x is not None for x in self.ids], np.uint8)
        numbers = np.array([x or 0 for x in self.ids], "<i8")
        body = b"".join(self.blocks)
        head = HEAD.pack(MAGIC, VERSION, BLOCK, len(sizes), self.total, len(self.ids))
        return b"".join([head, body, starts.astype("<u8").tobytes(), known.tobytes(), numbers.tobytes(), np.concatenate(self.lengths).astype("<u4").tobytes(), struct.pack("<Q", HEAD.size + len(body))])


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """A file's document ids (None where there is none), the number of ids of each, and all ids."""
    magic, version, length, blocks, total, docs = HEAD.unpack_from(content)
    if (magic, version, length) != (MAGIC, VERSION, BLOCK):
        raise ValueError("not a token file of this version")
    at = struct.unpack_from("<Q", content, len(content) - 8)[0]
    starts = np.frombuffer(content, "<u8", blocks, at).astype(np.int64)
    at += 8 * blocks
    known = np.frombuffer(content, np.uint8, docs, at).astype(bool)
    numbers = np.frombuffer(content, "<i8", docs, at + docs)
    sizes = np.frombuffer(content, "<u4", docs, at + 9 * docs).astype(np.int64)
    ids = unpack(np.frombuffer(content, np.uint8), starts)[:total]
    return [x if k else None for x, k in zip(numbers.tolist(), known.tolist(), strict=True)], sizes, ids


def put(path: str, content: bytes) -> None:
    """Write a file whole or not at all: under another name first, then renamed. A task that runs twice writes the same."""
    from pyarrow import fs

    store, name = (fs.LocalFileSystem(), path) if not urlparse(path).scheme else fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    task = TaskContext.get()
    part = f"{name}.{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(part) as file:
        file.write(content)
    store.move(part, name)


#: Bytes of blocks at which a file is closed and the next begun.
MOST_BYTES = 64 << 20


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them to `path` (a folder that all machines see), in ascending id order; returns the
    manifest: (file, first long: ids in all files before, n_ids, n_docs), a row for each file.

    Documents are dealt by ranges of ids and, of many rows of one id, of how their texts begin, so that file n holds
    smaller ids than file n + 1; a task writes files of about `most_bytes`, whatever it is dealt. A document is in one
    file. end_id is appended to each document. A null text is empty: its end alone; null ids come first; rows of equal id
    stand in the order of their texts; other columns are not read; an empty table writes no file."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, out, files = encoder(vocabulary), FileWriter(), 0
        tail = [] if end_id is None else [end_id]

        def roll() -> pa.RecordBatch:
            nonlocal out, files
            name = f"part-{TaskContext.get().partitionId():06d}-{files:06d}.tokens"
            put(f"{path}/{name}", out.close())
            row = pa.RecordBatch.from_pydict({"file": [name], "n_ids": [out.total], "n_docs": [len(out.ids)]})
            out, files = FileWriter(), files + 1
            return row

        for batch in small_batches(batches, most=min(BATCH_BYTES, most_bytes)):
            flat, at = codes.encode(batch.column(1))
            if tail:
                flat = np.insert(flat.astype(np.uint32), at[1:], end_id)
            out.add(batch.column(0).to_pylist(), flat, np.diff(at) + len(tail))
            if out.size >= most_bytes:
                yield roll()
        if out.ids:
            yield roll()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the beginnings of texts are in the order of the texts
    ranged = rows.repartitionByRange("id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    # a row for each file
    files = sorted((r.file, r.n_ids, r.n_docs) for r in ranged.mapInArrow(write, "file string, n_ids bigint, n_docs bigint").collect())
    first, manifest = 0, []
    for name, n_ids, n_docs in files:
        manifest.append((name, first, n_ids, n_docs))
        first += n_ids
    return spark.createDataFrame(manifest, "file string, first bigint, n_ids bigint, n_docs bigint")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; start counts the ids of all documents before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column("content"), batch.column("first").to_pylist(), strict=True):
                docs, sizes, ids = read_file(content.as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.join(F.broadcast(manifest), "file").select("content", "first").mapInArrow(read, schema)
