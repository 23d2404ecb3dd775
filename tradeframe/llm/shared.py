"""What the operators of this subpackage share: tables written to the folder that all machines see, and batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tradeframe.sources.written import remove, scratch, write_once


class Saved:
    """A DataFrame written once as Parquet in the shared folder: its lineage ends there, so a lost executor costs no
    more than a read. drop() deletes the files when nothing will read them again."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        write_once(df, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table that Saved writes, where it is kept as long as its reader lives."""
    return Saved(df, name).df


#: About what a batch that goes to Python may hold; a batch has one row at least.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return to the machine what this worker has freed. Spark keeps workers for the tasks that follow, and an allocator keeps
    what it once had: without this each worker would stay as large as its largest task was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one column of each holds about `most` bytes, or one row. After the last, freed memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(column).nbytes
        step = max(1, batch.num_rows * most // max(size, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def over_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: int = 1, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, most):
            yield step(batch)

    return df.mapInArrow(run, schema)
