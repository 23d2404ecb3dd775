"""Candles at given times, what a scored sample says to do, and both in one table; rates of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.operators.places import quantiles, running

SECOND = 1_000_000


def grid_candles(priced: DataFrame, grid: DataFrame, seconds: int = 60, scale: float = 1e9) -> DataFrame:
    """(mint, sample_us, open, high, low, close, volume, transactions) for each row of grid (mint, sample_us): of the trades after
    sample - seconds, up to the sample. One without trades has the close before it throughout, 0 before the first trade.
    Prices are times `scale`. Samples are distinct.

    A window of so many seconds lies in two stretches of that width: samples and trades meet by coin and stretch, and not by
    range. A close is carried on within the samples up to the next candle with trades, found by a running count dealt by
    ranges, so a coin's samples are not one task."""
    width = seconds * SECOND
    asked = grid.select("mint", "sample_us").withColumn("__stretch", F.explode(F.array(F.floor(F.col("sample_us") / width), F.floor(F.col("sample_us") / width) - 1)))
    offered = priced.select("mint", "us", "row_index", (F.col("price") * scale).alias("price"), "sol_amount", F.floor(F.col("us") / width).alias("__stretch"))
    met = asked.join(offered, ["mint", "__stretch"]).where((F.col("us") <= F.col("sample_us")) & (F.col("us") > F.col("sample_us") - width))
    at = F.struct("us", "row_index")
    made = met.groupBy("mint", "sample_us").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("sol_amount").alias("volume"), F.count("*").alias("transactions"))
    rows = grid.select("mint", "sample_us").join(made, ["mint", "sample_us"], "left").withColumn("__has", F.col("close").isNotNull().cast("long"))
    rows = running(rows, ["mint"], ["sample_us"], {"__has": "__before"}).withColumn("__group", F.col("__before") + F.col("__has"))
    carried = F.coalesce(F.max("close").over(Window.partitionBy("mint", "__group")), F.lit(0.0))
    out = [F.coalesce(c, carried).alias(c) for c in ("open", "high", "low", "close")]
    return rows.select("mint", "sample_us", *out, F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("transactions", F.lit(0)).cast("long").alias("transactions"))


def trade_signals(scored: DataFrame, high: float = 0.65, contrarian: int = 1, bands: Sequence[tuple[float, float]] = ((0.13, 0.14), (0.16, 0.17)), hours: tuple[float, float] = (1.0, 10.0)) -> DataFrame:
    """Add safe_long_signal (score from `high` on), contrarian_signal (score in one of some bands, ends included, in one regime),
    signal_type (the second over the first), hours_since_start of the coin's first sample and valid_trading_window."""
    first = scored.groupBy("coin_id").agg(F.min("sample_us").alias("__first"))
    inside = F.lit(False)
    for low, top in bands:
        inside = inside | F.col("score").between(low, top)
    long, turned = F.col("score") >= high, F.coalesce((F.col("regime") == contrarian) & inside, F.lit(False))
    since = (F.col("sample_us") - F.col("__first")) / 3.6e9
    kind = F.when(turned, "contrarian").when(long, "safe_long").otherwise("none")
    return scored.join(first, "coin_id").withColumns({
        "safe_long_signal": F.coalesce(long, F.lit(False)).cast("int"), "contrarian_signal": turned.cast("int"), "signal_type": kind, "hours_since_start": since, "valid_trading_window": since.between(*hours).cast("int"),
    }).drop("__first")


def signal_candles(priced: DataFrame, signals: DataFrame, seconds: int = 60, scale: float = 1e9) -> DataFrame:
    """Candles at the samples of trade_signals(), each with what its sample says."""
    candles = grid_candles(priced, signals.select(F.col("coin_id").alias("mint"), "sample_us"), seconds, scale)
    return candles.withColumnRenamed("mint", "coin_id").join(signals, ["coin_id", "sample_us"])


def token_rates(tokens: DataFrame, suffix: str = "pump", diverse: int = 5) -> DataFrame:
    """Add to a table of token volumes: trading_hours, trades_per_trader, trades_per_hour (a tenth of an hour added), sol_per_trader,
    non_sol_ratio, is_diverse (so many counterparts) and is_launchpad, by how the address ends."""
    hours = (F.col("last_us") - F.col("first_us")) / 3.6e9
    return tokens.withColumns({
        "trading_hours": hours, "trades_per_trader": F.try_divide(F.col("total_trades"), F.col("unique_traders")), "trades_per_hour": F.col("total_trades") / (hours + 0.1),
        "sol_per_trader": F.try_divide(F.col("total_sol_volume"), F.col("unique_traders")), "non_sol_ratio": F.try_divide(F.col("non_sol_pair_trades"), F.col("sol_pair_trades") + F.col("non_sol_pair_trades")),
        "is_diverse": F.col("unique_pairs") >= diverse, "is_launchpad": F.lower("mint").endswith(suffix.lower()),
    })


def launchpad_split(rates: DataFrame, shares: Sequence[float] = (0.1, 0.5)) -> DataFrame:
    """(is_launchpad, tokens, token_share, total_volume, mean_volume, median_volume, mean_trades, mean_non_sol_ratio, over_<share>..,
    diverse): the launch platform's tokens against all others; over_<share>: tokens with more of their trades without the base."""
    count = lambda on: F.count_if(on)
    out = rates.groupBy("is_launchpad").agg(
        F.count("*").alias("tokens"), F.sum("total_sol_volume").alias("total_volume"), F.avg("total_sol_volume").alias("mean_volume"), F.avg("total_trades").alias("mean_trades"), F.avg("non_sol_ratio").alias("mean_non_sol_ratio"),
        *(count(F.col("non_sol_ratio") > s).alias(f"over_{s:g}".replace(".", "_")) for s in shares), count("is_diverse").alias("diverse"),
    )
    middle = quantiles(rates, ["is_launchpad"], "total_sol_volume", {"median_volume": 0.5})
    all_: Column = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return out.join(middle, "is_launchpad").withColumn("token_share", F.col("tokens") / all_)
