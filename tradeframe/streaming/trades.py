"""Trades as a stream: late copies dropped, and price bars closed by a watermark. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def stream_dedup(trades: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Each key's first row; copies that come within the watermark's delay are dropped. A key's state goes with the watermark."""
    return trades.withWatermark("block_timestamp", late).dropDuplicatesWithinWatermark(list(keys))


def stream_ohlc(priced: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Bars by coin and stretch of time, emitted once, when the watermark has passed their end; later trades are dropped."""
    at = F.struct("block_timestamp", "row_index")
    bars = priced.withWatermark("block_timestamp", late).groupBy("mint", F.window("block_timestamp", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("sol_amount").alias("sol_volume"), F.count("*").alias("transactions")
    )
    return bars.select("mint", F.col("w.start").alias("start"), "open", "high", "low", "close", "sol_volume", "transactions")


def stream_first_hours(trades: DataFrame, hours: float = 2.0, late: str = "10 minutes") -> DataFrame:
    """Trades of each coin's first hours: those less than `hours` after its first trade, as the batch operator has them.

    A trade waits until the watermark has passed it: then none before it can come any more, and the coin's first is known.
    What waits is bounded by the watermark's delay. Once the first hours are over for certain, the coin's later trades pass
    by unread and only its first time stays, eight bytes a coin: without it the coin would begin anew. Trades that come
    later than the watermark allows are dropped. Rows of null coin or time are left out."""
    schema, span = trades.schema, int(hours * 3_600_000_000)
    names = [f.name for f in schema]
    rows = trades.where("mint is not null and block_timestamp is not null").withWatermark("block_timestamp", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, waiting = state.get if state.exists else (None, b"")
        mark = state.getCurrentWatermarkMs() * 1000
        held, sealed = [], []
        for part in chain([pickle.loads(waiting)] if waiting else [], [] if state.hasTimedOut else batches):
            us = micros(part["block_timestamp"])
            ready, later = part[us < mark], part[us >= mark]
            if first is not None:
                ready, later = ready[micros(ready["block_timestamp"]) < first + span], later[micros(later["block_timestamp"]) < first + span]
                yield ready[names]
            else:
                sealed.append(ready)
            held.append(later)
        if first is None and sum(map(len, sealed)):
            ready = pd.concat(sealed)
            us = micros(ready["block_timestamp"])
            first = int(us.min())
            yield ready[us < first + span][names]
        left = pd.concat(held) if sum(map(len, held)) else None
        state.update((first, b"" if left is None else pickle.dumps(left)))
        if left is not None:
            state.setTimeoutTimestamp(max(int(micros(left["block_timestamp"]).min() // 1000), state.getCurrentWatermarkMs()) + 1)

    return rows.groupBy("mint").applyInPandasWithState(step, schema, "first bigint, waiting binary", "append", "EventTimeTimeout")


def micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")
