"""Trades and bars made of the tables that a folder has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The asset that prices are in; the adapter's short name for it.
BASE = "SOL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps made of `events`: mint, block_timestamp, succeeded, swapper, both legs, row_index."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    price = F.lit(1e-3) * (F.lit(1e0) + F.col("k") / F.lit(1e2))
    mint = F.concat(F.lit("coin_"), "event_type")
    base = F.when(F.col("k") % 10 == 9, "USDC").otherwise(BASE)
    buy = F.col("k") % 2 == 0
    return rows.select(
        mint.alias("mint"),
        F.col("ts").alias("block_timestamp"),
        (F.col("event_id") % 20 != 0).alias("succeeded"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("swapper"),
        F.when(buy, F.col("value")).otherwise(F.col("value") / price).alias("swap_from_amount"),
        F.when(buy, base).otherwise(mint).alias("swap_from_mint"),
        F.when(buy, F.col("value") / price).otherwise(F.col("value")).alias("swap_to_amount"),
        F.when(buy, mint).otherwise(base).alias("swap_to_mint"),
        F.col("event_id").alias("row_index"),
    )


#: The same in SQL.
TRADES_SQL = """WITH raw AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
), priced AS (
  SELECT *, 1e-3 * (1e0 + k / 1e2) AS price, CASE WHEN k % 10 = 9 THEN 'USDC' ELSE 'SOL' END AS base, 'coin_' || event_type AS mint FROM raw
), trades AS (
  SELECT mint, ts AS block_timestamp, event_id % 20 <> 0 AS succeeded, 'u' || CAST(user_id AS VARCHAR) AS swapper,
    CASE WHEN k % 2 = 0 THEN value ELSE value / price END AS swap_from_amount, CASE WHEN k % 2 = 0 THEN base ELSE mint END AS swap_from_mint,
    CASE WHEN k % 2 = 0 THEN value / price ELSE value END AS swap_to_amount, CASE WHEN k % 2 = 0 THEN mint ELSE base END AS swap_to_mint,
    event_id AS row_index
  FROM priced
), norm AS (
  SELECT *, mint = swap_to_mint AS is_buy, mint = swap_from_mint AS is_sell,
    CASE WHEN mint = swap_to_mint AND swap_from_mint = 'SOL' THEN swap_from_amount WHEN mint = swap_from_mint AND swap_to_mint = 'SOL' THEN swap_to_amount ELSE 0e0 END AS sol_amount,
    CASE WHEN mint = swap_to_mint THEN swap_to_amount WHEN mint = swap_from_mint THEN swap_from_amount ELSE 0e0 END AS token_amount,
    epoch_us(block_timestamp) AS us
  FROM trades
), pairs AS (
  SELECT * FROM norm WHERE succeeded AND (swap_from_mint = 'SOL' OR swap_to_mint = 'SOL') AND mint <> 'SOL'
), priced_pairs AS (
  SELECT *, sol_amount / token_amount AS price FROM pairs WHERE sol_amount > 0 AND token_amount > 0
)
"""
