"""How a series goes with its own past: reversion to the mean, natural time scales, rolling ranks.

Series are dealt in pieces of their places that overlap by what a frame or lag reaches (see `places`), so none is one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tradeframe.operators.bars import rolling
from tradeframe.operators.places import numbered, overlapped, own, pair_corr, piece, quantiles
from tradeframe.operators.samples import with_gap

SECOND = 1_000_000

#: Of returns: lags of autocorrelation, and steps of variance ratios.
LAGS, STEPS = (1, 2, 3, 5, 10), (2, 5)


def mean_reversion_by_scale(bars: DataFrame, seconds: Sequence[int], lags: Sequence[int] = LAGS, steps: Sequence[int] = STEPS, size: int = 100_000) -> DataFrame:
    """(symbol, seconds, n, autocorr_<lag>.., ar1_beta, ar1_alpha, half_life, variance_ratio_<k>..) of the returns of closes
    at each scale: the regression of a return on the one before, the bars after which half of a shock is left (null where
    beta is 0 or 1 and more either way), and the variance of overlapping sums of k returns against k times that of one,
    null under 2 k returns. Steps without a bar are left out. All scales go together."""
    wide = bars.select("symbol", "us", "close", F.explode(F.array(*(F.lit(s).cast("long") for s in seconds))).alias("seconds"))
    closes = wide.groupBy("symbol", "seconds", F.floor(F.col("us") / (F.col("seconds") * SECOND)).alias("slot")).agg(F.max_by("close", "us").alias("close"))
    rows = closes.select(F.struct("symbol", "seconds").alias("key"), (F.col("slot") * F.col("seconds") * SECOND).alias("us"), "close")
    reach = max(*lags, *steps) + 1
    rows = overlapped(numbered(rows, "key", "us", ["us"]), reach, size=size)
    w = piece("key")
    rows = rows.withColumn("r", F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)))
    frame = {k: w.rowsBetween(1 - k, 0) for k in steps}
    sums = {f"sum_{k}": F.when(F.count("r").over(frame[k]) == k, F.sum("r").over(frame[k])) for k in steps}
    rows = own(rows.withColumns({f"r{k}": F.lag("r", k).over(w) for k in {1, *lags}} | sums)).where("r is not null")
    beta = F.regr_slope("r", "r1")
    n = F.count("*")
    out = rows.groupBy("key").agg(
        n.alias("n"),
        *(pair_corr(F.col("r"), F.col(f"r{k}")).alias(f"autocorr_{k}") for k in lags),
        beta.alias("ar1_beta"),
        F.regr_intercept("r", "r1").alias("ar1_alpha"),
        *(F.when(n >= 2 * k, F.try_divide(F.var_samp(f"sum_{k}"), k * F.var_samp("r"))).alias(f"variance_ratio_{k}") for k in steps),
    )
    size_of = F.abs("ar1_beta")
    half = F.when((size_of > 0) & (size_of < 1), -F.log(F.lit(2.0)) / F.log(size_of))
    return out.select("key.symbol", "key.seconds", "n", *(f"autocorr_{k}" for k in lags), "ar1_beta", "ar1_alpha", half.alias("half_life"), *(f"variance_ratio_{k}" for k in steps))


#: Seconds of the scales that are compared: all are multiples of the first.
SCALES = (5, 10, 30, 60, 120, 300, 600, 900, 1800)


def natural_scales(pairs: DataFrame, seconds: Sequence[int] = SCALES, least: int = 10, size: int = 100_000) -> DataFrame:
    """(mint, scale_s, slots, volume_autocorr, txn_autocorr, buy_autocorr, avg_autocorr, volume_snr, txn_snr, place) of the
    steps that have trades at each scale, where there are `least` of them: autocorrelation at lag 1 of volume, trades and the
    share of buys, their mean (null if one is), mean over deviation of volume and trades (0 without deviation), and the
    scale's place in its coin by the mean autocorrelation, nulls last, the finer of equals first.

    Trades are summed at the finest scale; wider steps are sums of those."""
    if any(s % seconds[0] for s in seconds):
        raise ValueError("scales must be multiples of the first")
    finest = pairs.groupBy("mint", F.floor(F.col("us") / (seconds[0] * SECOND)).alias("step")).agg(F.sum("sol_amount").alias("volume"), F.count("*").alias("n"), F.count_if("is_buy").alias("buys"))
    wide = finest.withColumn("scale_s", F.explode(F.array(*(F.lit(s).cast("long") for s in seconds))))
    slots = wide.groupBy("mint", "scale_s", F.floor(F.col("step") * seconds[0] / F.col("scale_s")).alias("slot")).agg(*(F.sum(c).alias(c) for c in ("volume", "n", "buys")))
    rows = slots.select(F.struct("mint", "scale_s").alias("key"), (F.col("slot") * F.col("scale_s") * SECOND).alias("us"), "volume", F.col("n").cast("double").alias("n"), (F.col("buys") / F.col("n")).alias("buy"))
    rows = overlapped(numbered(rows, "key", "us", ["us"]), 1, size=size)
    rows = own(rows.withColumns({f"{c}_before": F.lag(c).over(piece("key")) for c in ("volume", "n", "buy")}))
    snr = lambda c: F.coalesce(F.try_divide(F.avg(c), F.stddev_samp(c)), F.lit(0.0))
    auto = lambda c: pair_corr(F.col(c), F.col(f"{c}_before"))
    out = rows.groupBy("key").agg(F.count("*").alias("slots"), auto("volume").alias("volume_autocorr"), auto("n").alias("txn_autocorr"), auto("buy").alias("buy_autocorr"), snr("volume").alias("volume_snr"), snr("n").alias("txn_snr")).where(F.col("slots") >= least)
    out = out.withColumn("avg_autocorr", (F.col("volume_autocorr") + F.col("txn_autocorr") + F.col("buy_autocorr")) / 3)
    place = F.row_number().over(Window.partitionBy("key.mint").orderBy(F.col("avg_autocorr").desc_nulls_last(), "key.scale_s"))
    return out.select("key.mint", "key.scale_s", "slots", "volume_autocorr", "txn_autocorr", "buy_autocorr", "avg_autocorr", "volume_snr", "txn_snr", place.alias("place"))


def recommended_windows(pairs: DataFrame, scales: DataFrame) -> DataFrame:
    """(mint, ultra_short, short, medium, long, optimal_autocorr, windows): look-back seconds by a coin's gaps between trades
    and its best scale: three times the least gap (2 at least), ten times the median (30), five times the third quartile
    (120), twice the ninth decile (300), the scale of highest mean autocorrelation (null where none has one), and all of
    them, distinct and ascending. Coins of one trade have none."""
    gaps = with_gap(pairs).where("gap_us is not null").select("mint", (F.col("gap_us") / float(SECOND)).alias("gap"))
    points = quantiles(gaps, ["mint"], "gap", {"least": 0.0, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    best = scales.where("place = 1 and avg_autocorr is not null").select("mint", F.col("scale_s").cast("double").alias("optimal_autocorr"))
    at = lambda c, times, least: F.greatest(F.col(c) * times, F.lit(float(least)))
    out = points.join(best, "mint", "left").withColumns({"ultra_short": at("least", 3, 2), "short": at("p50", 10, 30), "medium": at("p75", 5, 120), "long": at("p90", 2, 300)})
    names = ("ultra_short", "short", "medium", "long", "optimal_autocorr")
    return out.select("mint", *names, F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))).alias("windows"))


#: Comparisons that one step of numpy makes.
AT_ONCE = 1 << 22


def percent_ranks(values: np.ndarray, width: int) -> np.ndarray:
    """For each value its rank among the last `width`, itself included, in per cent, ties at their mean; nan where there are
    not so many or one is nan."""
    out = np.full(len(values), np.nan)
    if len(values) < width:
        return out
    frames = np.lib.stride_tricks.sliding_window_view(values, width)
    step = max(1, AT_ONCE // width)
    for i in range(0, len(frames), step):
        part = frames[i : i + step]
        last = part[:, -1:]
        rank = ((part < last).sum(1) + ((part == last).sum(1) + 1) / 2) * 100.0 / width
        out[i + width - 1 : i + width - 1 + len(part)] = np.where(np.isnan(part).any(1), np.nan, rank)
    return out


def rolling_percent_rank(rows: DataFrame, by: str, at: str, value: str, width: int, name: str = "pct_rank", size: int = 100_000) -> DataFrame:
    """Add `name`: a value's rank among the last `width` of its group in the order of `at`, in per cent, ties at their mean; null
    in the first rows and where one of the values is null. Rows of null group or time are left out.

    No row carries its frame: a piece of places, which no group's size changes, is ranked as one array."""
    dealt = overlapped(numbered(rows, by, at, [at]), width - 1, size=max(size, width))
    schema = StructType([*dealt.schema.fields, StructField(name, DoubleType())])

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        return part.assign(**{name: percent_ranks(part[value].to_numpy("float64", na_value=np.nan), width)})

    return own(dealt.groupBy(by, "__piece").applyInPandas(rank, schema)).drop("place").withColumn(name, F.nanvl(F.col(name), F.lit(None)))


def volume_entries(bars: DataFrame, lookback: int = 20, entry: float = 2.0, percentile: float = 80.0, hold: int = 5, size: int = 100_000) -> DataFrame:
    """Entries against a move on high volume: 1 where the close is `entry` deviations under its mean of `lookback` bars, -1 over
    it, and the volume ranks at `percentile` or more among the last 5 * `lookback` bars; with the return after `hold` bars."""
    ranked = rolling_percent_rank(bars.select("symbol", "us", "close", "volume"), "symbol", "us", "volume", 5 * lookback, "volume_rank", size)
    rows = overlapped(numbered(ranked, "symbol", "us", ["us"]), lookback - 1, hold, size=max(size, lookback, hold))
    w = piece("symbol")
    over = lambda fn: rolling(fn, "close", lookback, lookback, w)
    rows = own(rows.withColumns({"ma": over(F.avg("close")), "sd": over(F.stddev_samp("close")), "later": F.lead("close", hold).over(w)}))
    rows = rows.withColumn("zscore", F.try_divide(F.col("close") - F.col("ma"), F.col("sd")))
    busy: Column = F.col("volume_rank") >= percentile
    signal = F.when(busy & (F.col("zscore") <= -entry), 1).when(busy & (F.col("zscore") >= entry), -1).otherwise(0)
    return rows.select("symbol", "us", "zscore", "volume_rank", signal.alias("signal"), (signal * (F.try_divide(F.col("later"), F.col("close")) - 1)).alias("signal_return"))
