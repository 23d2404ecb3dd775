"""Window features, forward labels, actions and segments over a stream of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradeframe.functions.columns import ratio
from tradeframe.operators.clusters import SEGMENTS, score_traders
from tradeframe.operators.windows import window_columns, window_parts


def stream_trades(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, at most `files` new ones a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_window_features(pairs: DataFrame, seconds: Sequence[int] = (30, 60, 120), step: int = 60, late: str = "10 minutes") -> DataFrame:
    """(mint, sample_ts, and for each look-back window trades, volume, buy_ratio and traders, the last approximate):
    samples every `step` seconds since 1970, of coins that traded in the longest window. A trade goes to the few samples
    whose longest window holds it; a sample comes out once, when the watermark has passed it."""
    widest = max(seconds)
    rows = pairs.withWatermark("block_timestamp", late).withColumn("w", F.window("block_timestamp", f"{widest} seconds", f"{step} seconds"))
    age = F.unix_micros(F.col("w.end")) - F.unix_micros("block_timestamp")
    out = []
    for s in seconds:
        inside = age <= s * 1_000_000
        volume, bought = F.sum(F.when(inside, F.col("sol_amount")).otherwise(0.0)), F.sum(F.when(inside & F.col("is_buy"), F.col("sol_amount")).otherwise(0.0))
        out += [F.count_if(inside).alias(f"trades_{s}s"), volume.alias(f"volume_{s}s"), ratio(bought, volume).alias(f"buy_ratio_{s}s"), F.approx_count_distinct(F.when(inside, F.col("swapper"))).alias(f"traders_{s}s")]
    grouped = rows.groupBy("mint", "w").agg(*out)
    return grouped.select("mint", F.col("w.end").alias("sample_ts"), *[c for c in grouped.columns if c not in ("mint", "w")])


def stream_window_feature_set(pairs: DataFrame, named: Sequence[tuple[str, int]] = (("30s", 30), ("60s", 60), ("120s", 120)), step: int = 60, late: str = "10 minutes") -> DataFrame:
    """(coin_id, sample_us, and the 23 features of each look-back window of the batch operator, traders counted exactly): samples
    every `step` seconds since 1970, of coins that traded in the longest window, out once the watermark has passed them.

    Trades are summed by trader and sample first, and those rows by sample: two aggregations that keep state until the
    watermark, so a hot coin's trades spread over its traders. `step` divides the longest window, and a trade at a sample's
    own time is in the windows after it."""
    widest = max(s for _, s in named)
    rows = pairs.withWatermark("block_timestamp", late).withColumn("w", F.window("block_timestamp", f"{widest} seconds", f"{step} seconds"))
    rows = rows.withColumn("back", F.unix_micros(F.col("w.end")) - F.unix_micros("block_timestamp"))
    sums, flags = window_parts(named)
    parts = sums | flags
    by_trader = rows.groupBy("mint", "w", "swapper").agg(*(c.alias(n) for n, c in parts.items()))
    grouped = by_trader.groupBy("mint", "w").agg(*(F.sum(n).alias(n) for n in parts))
    return grouped.select(F.col("mint").alias("coin_id"), F.unix_micros(F.col("w.end")).alias("sample_us"), *window_columns(named))


def stream_forward_label(pairs: DataFrame, forward: int = 300, step: int = 60, late: str = "10 minutes") -> DataFrame:
    """(mint, sample_ts, forward_buy, forward_sell, label): what is bought and sold from a sample on for `forward` seconds,
    and whether more is bought; out when the watermark has passed the window's end."""
    rows = pairs.withWatermark("block_timestamp", late)
    buy, sell = F.sum(F.when(F.col("is_buy"), F.col("sol_amount")).otherwise(0.0)), F.sum(F.when(F.col("is_sell"), F.col("sol_amount")).otherwise(0.0))
    grouped = rows.groupBy("mint", F.window("block_timestamp", f"{forward} seconds", f"{step} seconds").alias("w")).agg(buy.alias("forward_buy"), sell.alias("forward_sell"))
    return grouped.select("mint", F.col("w.start").alias("sample_ts"), "forward_buy", "forward_sell", (F.col("forward_buy") > F.col("forward_sell")).cast("int").alias("label"))


def stream_actions(scored: DataFrame, allowed: DataFrame, regime: str = "regime", enter: float = 0.65, leave: float = 0.35) -> DataFrame:
    """Add action: in an allowed regime BUY from `enter` on and SELL up to `leave`, else HOLD. `allowed` is a table of a
    row a regime; each batch joins it as it is then."""
    known = allowed.select(F.col(regime)).distinct().withColumn("__allowed", F.lit(True))
    rows = scored.join(known, regime, "left")
    action = F.when(F.col("__allowed") & (F.col("score") >= enter), "BUY").when(F.col("__allowed") & (F.col("score") <= leave), "SELL").otherwise("HOLD")
    return rows.withColumn("action", action).drop("__allowed")


def stream_segments(trades: DataFrame, profiles: DataFrame, features: Sequence[str], centroids: Sequence[Sequence[float]], names: dict[int, str] = SEGMENTS) -> DataFrame:
    """Add the trader's segment and its confidence from a table of a row a trader; null for traders it doesn't have."""
    scored = score_traders(profiles, features, centroids, names).select("swapper", "segment", F.col("confidence").alias("segment_confidence"))
    return trades.join(scored, "swapper", "left")
