"""Operators over bars (symbol, ts, open, high, low, close, volume): resampling, returns, quality, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tradeframe.operators.places import in_pieces, running


def bars_of(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Bars of `value` by event type: us is the bar's start."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = F.struct(us, F.col("event_id"))
    width = seconds * 1_000_000
    return events.groupBy(F.col("event_type").alias("symbol"), (F.floor(us / width) * width).alias("us")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("transactions")
    )


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Wider bars; empty ones are left out."""
    width = seconds * 1_000_000
    return bars.groupBy("symbol", (F.floor(F.col("us") / width) * width).alias("start_us")).agg(
        F.min_by("open", "us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "us").alias("close"), F.sum("volume").alias("volume"), F.sum("transactions").alias("transactions")
    )


def change(before: Column) -> Column:
    return F.try_divide(F.col("close") - before, before)


def with_returns(bars: DataFrame) -> DataFrame:
    """Add r: the close's change against the bar before of the symbol."""
    return in_pieces(bars, "symbol", "us", lambda rows, w: rows.withColumn("r", change(F.lag("close").over(w))), 1)


def rolling(fn: Column, column: str, width: int, least: int, over: WindowSpec) -> Column:
    """An aggregate of the last `width` rows; null where fewer than `least` have a value."""
    frame = over.rowsBetween(1 - width, 0)
    return F.when(F.count(column).over(frame) >= least, fn.over(frame))


def bar_quality(bars: DataFrame) -> DataFrame:
    """Bars that contradict themselves, by symbol."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return bars.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.col("high") < top).alias("high_below"), F.count_if(F.col("low") > bottom).alias("low_above"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("not_positive"), F.count_if(F.col("volume") <= 0).alias("no_volume"),
    )


def return_profile(bars: DataFrame) -> DataFrame:
    """Distribution of returns by symbol; skew and kurtosis as corrected for bias."""
    rows = with_returns(bars).where("r is not null")
    n, g1, g2 = F.count("r"), F.skewness("r"), F.kurtosis("r")
    return rows.groupBy("symbol").agg(
        n.alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        F.percentile("r", F.lit(0.05)).alias("p05"), F.percentile("r", F.lit(0.5)).alias("p50"), F.percentile("r", F.lit(0.95)).alias("p95"),
    )


def intraday_profile(bars: DataFrame) -> DataFrame:
    """Mean, spread and count of bar moves by hour, and the volume of rising against falling bars."""
    move = F.col("close") - F.col("open")
    up, down = F.sum(F.when(move > 0, F.col("volume")).otherwise(0.0)), F.sum(F.when(move < 0, F.col("volume")).otherwise(0.0))
    return bars.groupBy("symbol", (F.floor(F.col("us") / 3_600_000_000) % 24).alias("hour")).agg(F.avg(move).alias("mean_move"), F.stddev_samp(move).alias("std_move"), F.count("*").alias("n"), F.try_divide(up, down).alias("up_down"))


def day_gaps(bars: DataFrame) -> DataFrame:
    """Bars a day against the mean of the 21 days around; far fewer is a gap."""
    day = F.floor(F.col("us") / 86_400_000_000)
    days = bars.groupBy("symbol", day.alias("day")).agg(F.count("*").alias("n"))
    around = Window.partitionBy("symbol").orderBy("day").rowsBetween(-10, 10)
    days = days.withColumns({"mean_n": F.avg("n").over(around), "std_n": F.stddev_samp("n").over(around)})
    return days.withColumn("is_gap", F.col("n") < F.col("mean_n") - 2 * F.col("std_n"))


def volatility(bars: DataFrame, width: int = 20, least: int = 10) -> DataFrame:
    """Rolling spread of returns, and the price's distance to its rolling mean in rolling spreads."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("r", change(F.lag("close").over(w)))
        of = lambda fn, c: rolling(fn, c, width, least, w)
        return rows.withColumns({"vol": of(F.stddev_samp("r"), "r"), "ma": of(F.avg("close"), "close"), "sd": of(F.stddev_samp("close"), "close")})

    rows = in_pieces(bars, "symbol", "us", work, width)
    return rows.select("symbol", "us", "vol", F.try_divide(F.col("close") - F.col("ma"), F.col("sd")).alias("zscore"))


def drawdown(bars: DataFrame) -> DataFrame:
    """The close against the highest up to it: the highest before comes from ranges of the symbol's bars."""
    rows = running(bars.select("symbol", "us", "close"), ["symbol"], ["us"], {"close": "__peak"}, most=True)
    return rows.select("symbol", "us", "close", (F.col("close") / F.greatest("close", "__peak") - 1).alias("drawdown"))


def corr(x: str, y: str) -> Column:
    """Pearson correlation, null where either side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.when(F.stddev_pop(x) * F.stddev_pop(y) > 0, F.stddev_pop(x) * F.stddev_pop(y)))


def mean_reversion(bars: DataFrame) -> DataFrame:
    """Autocorrelation of returns at lags 1, 2 and 5, by symbol."""
    rows = in_pieces(with_returns(bars).where("r is not null"), "symbol", "us", lambda rows, w: rows.withColumns({f"r{k}": F.lag("r", k).over(w) for k in (1, 2, 5)}), 5)
    both = [corr(f"x{k}", f"r{k}").alias(f"autocorr_{k}") for k in (1, 2, 5)]
    return rows.withColumns({f"x{k}": F.when(F.col(f"r{k}").isNotNull(), F.col("r")) for k in (1, 2, 5)}).groupBy("symbol").agg(F.count("*").alias("n"), *both)


def forward_returns(bars: DataFrame, rows_ahead: int = 4) -> DataFrame:
    """The close some bars on against this one's; null at the end."""
    rows = in_pieces(bars.select("symbol", "us", "close"), "symbol", "us", lambda rows, w: rows.withColumn("later", F.lead("close", rows_ahead).over(w)), 0, rows_ahead)
    return rows.select("symbol", "us", F.try_divide(F.col("later"), F.col("close")).alias("growth"))
