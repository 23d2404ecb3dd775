"""Returns, sessions, days and volatility of bars (symbol, us, open, high, low, close, volume) in full.

Frames and lags run over pieces of a symbol's bars that overlap by what they reach, running sums over ranges: a symbol is
not one task. Windows over days have a row a day."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.operators import places
from tradeframe.operators.bars import rolling
from tradeframe.operators.places import numbered, overlapped, own, pair_corr, piece, quantiles

MINUTE, DAY = 60_000_000, 86_400_000_000


def dealt(bars: DataFrame, behind: int, ahead: int = 0, size: int = 100_000) -> DataFrame:
    return overlapped(numbered(bars, "symbol", "us", ["us"]), behind, ahead, max(size, behind, ahead))


def day(us: str = "us") -> Column:
    return F.floor(F.col(us) / DAY)


def return_set(bars: DataFrame, size: int = 100_000) -> DataFrame:
    """(symbol, us, close, r, r_day, log_r, cum_return): the change against the bar before, the same within a day (null at its
    first bar), its logarithm (null where either close is not above 0), and the product of all changes so far less 1, -1
    after a change of -1. Changes from 0 are null and leave the product as it is."""
    w = piece("symbol")
    before, earlier = F.lag("close").over(w), F.lag("us").over(w)
    rows = dealt(bars.select("symbol", "us", "close"), 1, size=size).withColumns({"before": before, "earlier": earlier})
    r = F.try_divide(F.col("close") - F.col("before"), F.col("before"))
    positive = (F.col("close") > 0) & (F.col("before") > 0)
    rows = own(rows).drop("place").withColumns({"r": r, "log_r": F.when(positive, F.log(F.col("close") / F.when(F.col("before") > 0, F.col("before"))))})
    rows = rows.withColumn("r_day", F.when(F.floor(F.col("earlier") / DAY) == day(), F.col("r")))
    lost = F.coalesce((F.col("r") <= -1).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumns({"__grown": F.coalesce(F.when(F.col("r") > -1, F.log1p(F.when(F.col("r") > -1, F.col("r")))), F.lit(0.0)), "__lost": lost})
    rows = places.running(rows, ["symbol"], ["us"], {"__grown": "__g", "__lost": "__l"})
    cum = F.when(F.col("__l") + F.col("__lost") > 0, -1.0).otherwise(F.exp(F.col("__g") + F.col("__grown")) - 1)
    return rows.select("symbol", "us", "close", "r", "r_day", "log_r", cum.alias("cum_return"))


def quantile_bucket(rows: DataFrame, by: Sequence[str], value: str, q: int = 4, name: str = "bucket") -> DataFrame:
    """Add `name`, 1 to q: which of q parts a value is in, cut at the group's quantiles, a value at a cut in the lower part; null
    for null."""
    cuts = quantiles(rows, by, value, {f"__q{i}": i / q for i in range(1, q)})
    at = sum((F.when(F.col(value) > F.col(f"__q{i}"), 1).otherwise(0) for i in range(1, q)), F.lit(1))
    joined = rows.join(cuts, list(by), "left") if by else places.with_cuts(rows, cuts)
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), at)).drop(*(f"__q{i}" for i in range(1, q)))


def sessions(bars: DataFrame, opens: int = 570, closes: int = 960, edge: int = 30, midday: tuple[int, int] = (690, 840)) -> DataFrame:
    """(symbol, us, minute, day_name, quarter, session, first_part, last_part, midday, lifecycle): minute of the day, and by it
    whether trading is regular, in its first or last `edge` minutes, or about noon; lifecycle is the bar's place in time from
    the symbol's first bar, 0, to its last, 1 (0 of one bar)."""
    minute = F.floor(F.col("us") / MINUTE) % 1440
    at = F.timestamp_micros("us")
    ends = bars.groupBy("symbol").agg(F.min("us").alias("__first"), F.max("us").alias("__last"))
    life = F.coalesce(F.try_divide((F.col("us") - F.col("__first")).cast("double"), F.col("__last") - F.col("__first")), F.lit(0.0))
    inside = lambda low, high: (minute >= low) & (minute < high)
    return bars.join(ends, "symbol").select(
        "symbol", "us", minute.alias("minute"), F.date_format(at, "EEEE").alias("day_name"), F.quarter(at).alias("quarter"), F.when(inside(opens, closes), "regular").otherwise("extended").alias("session"),
        inside(opens, opens + edge).alias("first_part"), inside(closes - edge, closes).alias("last_part"), inside(*midday).alias("midday"), life.alias("lifecycle"),
    )


def vwap_deviation(bars: DataFrame) -> DataFrame:
    """(symbol, us, deviation, deviation_pct): the close less the mean price of the bar's volume, and as a share of it in per cent."""
    off = F.col("close") - F.col("vwap")
    return bars.select("symbol", "us", off.alias("deviation"), (F.try_divide(off, F.col("vwap")) * 100).alias("deviation_pct"))


#: Shares of a distribution of returns.
SHARES = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def return_distribution(bars: DataFrame) -> DataFrame:
    """(symbol, n, mean, std, skew, kurtosis, p0_1 .. p99_9, extremes): moments as corrected for bias, nine percentiles, and how
    many returns lie beyond the first or the last of them."""
    rows = return_set(bars).where("r is not null").select("symbol", "r")
    n = F.count("r")
    names = {f"p{p * 100:g}".replace(".", "_"): p for p in SHARES}
    stats = rows.groupBy("symbol").agg(
        n.alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.when(n > 2, F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r") + 6)).alias("kurtosis"),
    )
    cuts = quantiles(rows, ["symbol"], "r", names)
    low, *_, high = names
    beyond = rows.join(cuts, "symbol").groupBy("symbol").agg(F.count_if((F.col("r") < F.col(low)) | (F.col("r") > F.col(high))).alias("extremes"))
    return stats.join(cuts, "symbol").join(beyond, "symbol")


def extreme_returns(bars: DataFrame, most: int = 10) -> DataFrame:
    """(symbol, us, close, r, place): each symbol's largest moves either way, of equals the earlier first. Spark cuts each task's
    rows to `most` a symbol before it deals them."""
    rows = return_set(bars).where("r is not null").select("symbol", "us", "close", "r")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.abs("r").desc(), "us"))).where(F.col("place") <= most)


def daily_detail(bars: DataFrame, opens: int = 570, hour: int = 60, half: int = 30) -> DataFrame:
    """(symbol, day, open, high, low, close, volume, and close, high, low, volume and return of the first `hour` and `half` hour
    from `opens` on, minutes of the day): one aggregation; null on days without such bars."""
    minute = F.floor(F.col("us") / MINUTE) % 1440
    out = [F.min_by("open", "us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "us").alias("close"), F.sum("volume").alias("volume")]
    for name, width in (("hour", hour), ("half", half)):
        on = (minute >= opens) & (minute < opens + width)
        at = F.when(on, F.col("us"))
        first, last = F.min_by("open", at), F.max_by("close", at)
        out += [last.alias(f"{name}_close"), F.max(F.when(on, F.col("close"))).alias(f"{name}_high"), F.min(F.when(on, F.col("close"))).alias(f"{name}_low"), F.sum(F.when(on, F.col("volume"))).alias(f"{name}_volume"), (F.try_divide(last, first) - 1).alias(f"{name}_return")]
    return bars.groupBy("symbol", day().alias("day")).agg(*out)


def volatility_table(bars: DataFrame, width: int = 30, lags: Sequence[int] = (1, 5, 10, 30, 60), year: float = 252 * 6.5 * 60, size: int = 100_000) -> DataFrame:
    """(symbol, n, abs_autocorr_<lag>, square_autocorr_<lag>, bound, significant, mean_vol, std_vol, least_vol, most_vol, p95_vol,
    high_periods, annual_vol): autocorrelation of the size and the square of returns, the bound 1.96 / sqrt(n) and how many
    squares' lags are beyond it; the rolling deviation of `width` returns (two at least) over time, its 95th percentile, how
    many are over it, and the mean one as of a year."""
    rows = return_set(bars, size).where("r is not null").select("symbol", "us", "r")
    rows = dealt(rows, max(*lags, width), size=size)
    w = piece("symbol")
    rows = rows.withColumns({f"r{k}": F.lag("r", k).over(w) for k in lags} | {"vol": rolling(F.stddev_samp("r"), "r", width, 2, w)})
    rows = own(rows)
    both = lambda f, k: pair_corr(f(F.col("r")), f(F.col(f"r{k}")))
    square = lambda x: x * x
    stats = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), *(both(F.abs, k).alias(f"abs_autocorr_{k}") for k in lags), *(both(square, k).alias(f"square_autocorr_{k}") for k in lags),
        F.avg("vol").alias("mean_vol"), F.stddev_samp("vol").alias("std_vol"), F.min("vol").alias("least_vol"), F.max("vol").alias("most_vol"),
    )
    cuts = quantiles(rows, ["symbol"], "vol", {"p95_vol": 0.95})
    high = rows.join(cuts, "symbol").groupBy("symbol").agg(F.count_if(F.col("vol") > F.col("p95_vol")).alias("high_periods"))
    bound = 1.96 / F.sqrt("n")
    beyond = sum((F.when(F.abs(f"square_autocorr_{k}") > bound, 1).otherwise(0) for k in lags), F.lit(0))
    return stats.join(cuts, "symbol", "left").join(high, "symbol", "left").withColumns({"bound": bound, "significant": beyond, "annual_vol": F.col("mean_vol") * math.sqrt(year)})


def volume_impact(bars: DataFrame, size: int = 100_000) -> DataFrame:
    """(symbol, bucket, n, mean_size, mean_spread_pct, mean_volume_z, volume_size_corr, next_size_corr, next_spread_corr): a row for
    each quarter of the symbol's volumes with the mean size of returns and spread and mean standard volume, beside how volume
    goes with the size of the return, with the next one, and with the next spread."""
    shaped = bars.withColumn("spread", F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100)
    rows = dealt(shaped.select("symbol", "us", "close", "volume", "spread"), 1, 1, size)
    w = piece("symbol")
    rows = rows.withColumn("size", F.abs(F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w))))
    # the next bar's size is from this bar's close: it needs no more of the piece than its next close
    rows = rows.withColumns({"next_size": F.abs(F.try_divide(F.lead("close").over(w) - F.col("close"), F.col("close"))), "next_spread": F.lead("spread").over(w)})
    rows = quantile_bucket(own(rows).drop("place"), ["symbol"], "volume", 4)
    v = F.col("volume")
    whole = rows.groupBy("symbol").agg(F.avg(v).alias("__mean"), F.stddev_samp(v).alias("__std"), pair_corr(v, F.col("size")).alias("volume_size_corr"), pair_corr(v, F.col("next_size")).alias("next_size_corr"), pair_corr(v, F.col("next_spread")).alias("next_spread_corr"))
    each = rows.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.avg("size").alias("mean_size"), F.avg("spread").alias("mean_spread_pct"), F.avg(v).alias("__volume"))
    return each.join(whole, "symbol").withColumn("mean_volume_z", F.try_divide(F.col("__volume") - F.col("__mean"), F.col("__std"))).drop("__mean", "__std", "__volume")


def day_counts(bars: DataFrame, around: int = 10) -> DataFrame:
    """(symbol, day, n, mean_n, std_n, is_gap, local_mean, local_std, is_local_gap): bars a day against two deviations under the
    mean of all days, and three under that of the days around. Windows run over a row a day."""
    days = bars.groupBy("symbol", day().alias("day")).agg(F.count("*").alias("n"))
    whole, near = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("day").rowsBetween(-around, around)
    days = days.withColumns({"mean_n": F.avg("n").over(whole), "std_n": F.stddev_samp("n").over(whole), "local_mean": F.avg("n").over(near), "local_std": F.stddev_samp("n").over(near)})
    return days.withColumns({"is_gap": F.coalesce(F.col("n") < F.col("mean_n") - 2 * F.col("std_n"), F.lit(False)), "is_local_gap": F.coalesce(F.col("n") < F.col("local_mean") - 3 * F.col("local_std"), F.lit(False))})


def time_counts(bars: DataFrame) -> DataFrame:
    """(symbol, kind, value, n): bars by weekday (1 is Sunday), by hour, and by the minutes since the bar before."""
    w = piece("symbol")
    steps = own(dealt(bars.select("symbol", "us"), 1).withColumn("step", F.floor((F.col("us") - F.lag("us").over(w)) / MINUTE)))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("value")) for k, v in (("weekday", F.dayofweek(F.timestamp_micros("us"))), ("hour", F.floor(F.col("us") / (60 * MINUTE)) % 24), ("interval", F.col("step")))))
    return steps.select("symbol", F.explode(kinds).alias("x")).where("x.value is not null").groupBy("symbol", "x.kind", "x.value").agg(F.count("*").alias("n"))


def regime_gaps(bars: DataFrame, gap: float = 0.01, width: int = 10, least: int = 5) -> DataFrame:
    """(symbol, day, gap, up_down_ratio, bullish, signal, regime_gap_return): where the volume of rising days exceeds that of falling
    ones over the last `width` (`least` at least), a gap up of over `gap` is bought and held to the close; where it doesn't, a
    gap down is sold. A ratio without falling volume is above any; without volume at all it is null, and nothing is done."""
    w = Window.partitionBy("symbol").orderBy("day")
    days = bars.groupBy("symbol", day().alias("day")).agg(F.min_by("open", "us").alias("open"), F.max_by("close", "us").alias("close"), F.sum("volume").alias("volume"))
    before = F.lag("close").over(w)
    days = days.withColumns({"gap": F.try_divide(F.col("open"), before) - 1, "held": F.try_divide(F.col("close"), F.col("open")) - 1, "up": F.coalesce(F.col("close") > before, F.lit(False))})
    frame = w.rowsBetween(1 - width, 0)
    enough = F.count("*").over(frame) >= least
    up, down = (F.when(enough, F.sum(F.when(on, F.col("volume")).otherwise(0.0)).over(frame)) for on in (F.col("up"), ~F.col("up")))
    days = days.withColumns({"__up": up, "__down": down})
    ratio = F.when(F.col("__down") > 0, F.col("__up") / F.col("__down")).when(F.col("__up") > 0, F.lit(float("inf")))
    days = days.withColumn("ratio", ratio).withColumn("bullish", F.col("ratio") > 1)
    signal = F.when(F.col("bullish") & (F.col("gap") > gap), 1).when(~F.col("bullish") & (F.col("gap") < -gap), -1).otherwise(0)
    return days.select("symbol", "day", "gap", F.when(F.col("ratio") < float("inf"), F.col("ratio")).alias("up_down_ratio"), "bullish", signal.alias("signal"), (signal * F.col("held")).alias("regime_gap_return"))


def mark_groups(df: DataFrame, value: str, regular: Column, k: float = 3.0, times: float = 10.0, least: float = 1000.0) -> DataFrame:
    """Values of regular rows drawn to the fences k quartile ranges beyond their own quartiles, and one marker value for all
    others: `times` the regular rows' 99th percentile, `least` at least. Null values of regular rows stay null."""
    of = df.where(regular).select(F.col(value).alias("v"))
    cuts = quantiles(of, [], "v", {"__q1": 0.25, "__q3": 0.75, "__p99": 0.99})
    out = places.with_cuts(df, cuts)
    low, high = F.col("__q1") - k * (F.col("__q3") - F.col("__q1")), F.col("__q3") + k * (F.col("__q3") - F.col("__q1"))
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), high), low))
    return out.withColumn(value, F.when(regular, clipped).otherwise(F.greatest(F.col("__p99") * times, F.lit(least)))).drop("__q1", "__q3", "__p99")


#: Keeps a ratio defined where nothing was traded.
TINY = 1e-10


def interaction_set(df: DataFrame, windows: Sequence[str] = ("30s", "60s", "120s"), times: float = 4.0, shaped: Sequence[str] = ("buy_ratio_60s", "txn_flow_imbalance_60s", "volume_imbalance_120s")) -> DataFrame:
    """Add to window features: ratios of each two windows' buy ratios, volume a trade and a trader, the shortest window's volume
    `times` over against the longest's, and the squares and cube roots of some features."""
    c = F.col
    out = {f"buy_ratio_{a}_vs_{b}": c(f"buy_ratio_{a}") / (c(f"buy_ratio_{b}") + TINY) for a in windows for b in windows if a != b}
    for w in windows:
        out |= {f"volume_per_txn_{w}": c(f"total_volume_{w}") / (c(f"total_txns_{w}") + TINY), f"volume_per_trader_{w}": c(f"total_volume_{w}") / (c(f"unique_traders_{w}") + TINY)}
    out["volume_acceleration"] = c(f"total_volume_{windows[0]}") * times / (c(f"total_volume_{windows[-1]}") + TINY)
    for name in shaped:
        out |= {f"{name}_squared": c(name) * c(name), f"{name}_cbrt": F.cbrt(name)}
    return df.withColumns(out)
