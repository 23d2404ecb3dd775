"""Wide feature sets and outcomes of the windows about sample times.

As in `windows`, each trade is exploded to the samples whose windows hold it, so cost is linear in trades and a hot coin
spreads over its samples. Here a row is dealt once by (coin, sample, window); traders, distinct amounts and the window
itself are then aggregated where it lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.functions.columns import ratio
from tradeframe.operators import places
from tradeframe.operators.windows import SECOND, GridConfig, coin_ranges, in_parts, sampling_grid

KEYS = ("mint", "k", "window_s")

#: Size classes by the least amount and the amount below which.
CLASSES = {"small": (0, 1), "medium": (1, 10), "big": (10, 100), "whale": (100, None)}

#: Percentiles of amounts; the median has a name of its own.
PERCENTILES = (10, 25, 75, 90, 95, 99)


def of_class(amount: Column, name: str) -> Column:
    low, high = CLASSES[name]
    least = amount > low if low == 0 else amount >= low
    return least if high is None else least & (amount < high)


def in_windows(pairs: DataFrame, cfg: GridConfig, seconds: Sequence[int], ahead: bool = False) -> DataFrame:
    """A row for each trade, sample and window that holds it, with `window_s` and `back_us`, the time from trade to sample.
    Windows end before the sample, or begin at it (`ahead`)."""
    step, widest = cfg.step * SECOND, max(seconds) * SECOND
    since = F.col("us") - F.col("anchor")
    low, high = (F.floor((since - widest) / step) + 1, F.floor(since / step)) if ahead else (F.floor(since / step) + 1, F.floor((since + widest) / step))
    rows = pairs.join(coin_ranges(pairs, cfg).select("mint", "anchor", "k_max"), "mint")
    rows = rows.withColumns({"low": F.greatest(low, F.lit(0)), "high": F.least(high, F.col("k_max"))}).where("low <= high")
    rows = rows.withColumn("k", F.explode(F.sequence("low", "high"))).drop("low", "high", "k_max")
    rows = rows.withColumn("sample_us", F.col("anchor") + F.col("k") * step).drop("anchor").withColumn("back_us", F.col("sample_us") - F.col("us"))
    rows = rows.withColumn("window_s", F.explode(F.array(*(F.lit(s).cast("long") for s in seconds))))
    width = F.col("window_s") * SECOND
    return rows.where((-F.col("back_us") < width) if ahead else (F.col("back_us") <= width))


def _order_statistics(rows: DataFrame) -> DataFrame:
    """Of amounts by window: percentiles, the sum of the greatest, and those at or above the 90th percentile. Equal amounts
    are counted first, and what is ordered is sorted on disk."""
    counted = rows.groupBy(*KEYS, "sol_amount").agg(F.count("*").alias("n"), F.count_if("is_buy").alias("buys"))
    group = Window.partitionBy(*KEYS)
    counted = counted.withColumns({"upto": F.sum("n").over(group.orderBy("sol_amount")), "all": F.sum("n").over(group)})

    def at(p: float, over: bool = False) -> Column:
        spot, value = (F.col("all") - 1) * F.lit(p), F.col("sol_amount")
        on = (lambda c: c.over(group)) if over else (lambda c: c)
        low, high = (on(F.min(F.when(F.col("upto") > place, value))) for place in (F.floor(spot), F.ceil(spot)))
        rest = spot - F.floor(spot) if over else F.max(spot - F.floor(spot))
        return low + (high - low) * rest

    counted = counted.withColumn("large", at(0.9, over=True)).withColumn("above", F.col("all") - F.col("upto"))
    top = lambda k: F.sum(F.col("sol_amount") * (F.least(F.lit(k), F.col("above") + F.col("n")) - F.least(F.lit(k), F.col("above"))))
    large = F.col("sol_amount") >= F.col("large")
    return counted.groupBy(*KEYS).agg(
        at(0.5).alias("median_transaction_size"),
        *(at(p / 100).alias(f"volume_p{p}") for p in PERCENTILES),
        top(5).alias("top5"),
        top(10).alias("top10"),
        F.sum(F.when(large, F.col("n")).otherwise(0)).alias("large_order_count"),
        F.sum(F.when(large, F.col("buys")).otherwise(0)).alias("large_buy_count"),
    )


def _of_traders(rows: DataFrame) -> DataFrame:
    """Of traders by window: how often and how much each trades, and how many there are of each class."""
    amount = F.col("sol_amount")
    seen = {c: F.max(of_class(amount, c).cast("int")) for c in CLASSES}
    one = rows.groupBy(*KEYS, "swapper").agg(F.count("*").alias("n"), F.sum(amount).alias("volume"), *(v.alias(c) for c, v in seen.items()))
    group = Window.partitionBy(*KEYS)
    place = {c: F.row_number().over(group.orderBy(c)) for c in ("n", "volume")}
    one = one.withColumns({"all": F.count("*").over(group), "n_place": place["n"], "volume_place": place["volume"]})
    middle = lambda c: F.avg(F.when(F.abs(2 * F.col(f"{c}_place") - F.col("all") - 1) <= 1, F.col(c)))
    top = F.sum(F.when(F.col("volume_place") > F.col("all") - 3, F.col("volume")))
    return one.groupBy(*KEYS).agg(
        F.count("*").alias("unique_traders"),
        F.max("n").alias("max_txns_per_trader"),
        middle("n").alias("median_txns_per_trader"),
        F.count_if(F.col("n") == 1).alias("single_txn_traders"),
        F.count_if(F.col("n") >= 5).alias("high_freq_traders"),
        F.max("volume").alias("max_volume_per_trader"),
        middle("volume").alias("median_volume_per_trader"),
        top.alias("top3"),
        *(F.sum(c).alias(f"unique_traders_{c}") for c in CLASSES),
    )


def window_features_ext(pairs: DataFrame, cfg: GridConfig, seconds: Sequence[int] = (30, 60, 120, 300, 600)) -> DataFrame:
    """A row for each sample and window before it that has trades: (coin_id, sample_us, window_s) and some 75 features of
    volumes, traders and order flow. Skew and kurtosis are those of a sample, null below three and four trades or where
    amounts don't vary; the deviation is null for one trade; percentiles interpolate."""
    dealt = in_parts(in_windows(pairs, cfg, seconds).select(*KEYS, "sample_us", "swapper", "is_buy", "is_sell", "sol_amount"), *KEYS)
    amount, buy, sell = F.col("sol_amount"), F.col("is_buy"), F.col("is_sell")
    total = lambda on: F.sum(F.when(on, amount).otherwise(0.0))
    sums = {"total_volume": F.sum(amount), "total_transactions": F.count("*"), "volume_std": F.stddev_samp(amount), "skew": F.skewness(amount), "kurt": F.kurtosis(amount)}
    sums |= {"buy_count": F.count_if(buy), "sell_count": F.count_if(sell), "buy_volume": total(buy), "sell_volume": total(sell)}
    for c in CLASSES:
        on = of_class(amount, c)
        sums |= {f"volume_{c}": total(on), f"count_{c}": F.count_if(on), f"buys_{c}": F.count_if(on & buy), f"bought_{c}": total(on & buy)}
    whole = dealt.groupBy(*KEYS).agg(F.first("sample_us").alias("sample_us"), *(v.alias(n) for n, v in sums.items()))
    rows = whole.join(_order_statistics(dealt), list(KEYS)).join(_of_traders(dealt), list(KEYS))
    n, v, u, w = F.col("total_transactions").cast("double"), F.col("total_volume"), F.col("unique_traders").cast("double"), F.col("window_s")
    b, s = F.col("buy_count").cast("double"), F.col("sell_count").cast("double")
    varies = F.col("volume_std") > 0
    out = {
        "total_volume": v, "total_transactions": F.col("total_transactions"), "avg_transaction_size": v / n, "median_transaction_size": F.col("median_transaction_size"), "volume_std": F.col("volume_std"),
        "volume_skew": F.when((n > 2) & varies, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)),
        "volume_kurtosis": F.when((n > 3) & varies, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6)),
        "volume_intensity": v / w, "transaction_intensity": n / w,
        **{f"{part}_{c}": value for c in CLASSES for part, value in (("volume", F.col(f"volume_{c}")), ("count", F.col(f"count_{c}")), ("volume_ratio", ratio(F.col(f"volume_{c}"), v)))},
        **{f"volume_p{p}": F.col(f"volume_p{p}") for p in PERCENTILES},
        "volume_concentration_top5": ratio(F.col("top5"), v), "volume_concentration_top10": ratio(F.col("top10"), v),
        "unique_traders": F.col("unique_traders"), "transactions_per_trader": n / u, "trader_intensity": u / w,
        **{c: F.col(c) for c in ("max_txns_per_trader", "median_txns_per_trader", "single_txn_traders", "high_freq_traders", "max_volume_per_trader", "median_volume_per_trader")},
        "single_txn_trader_ratio": F.col("single_txn_traders") / u, "volume_trader_concentration": ratio(F.col("top3"), v),
        **{f"{part}_{c}": value for c in CLASSES for part, value in (("unique_traders", F.col(f"unique_traders_{c}")), ("trader_ratio", F.col(f"unique_traders_{c}") / u))},
        **{c: F.col(c) for c in ("buy_count", "sell_count", "buy_volume", "sell_volume")},
        "buy_ratio": b / n, "buy_volume_ratio": ratio(F.col("buy_volume"), v), "order_flow_imbalance": ratio(F.col("buy_volume") - F.col("sell_volume"), v), "transaction_flow_imbalance": (b - s) / n,
        "avg_buy_size": ratio(F.col("buy_volume"), b), "avg_sell_size": ratio(F.col("sell_volume"), s), "buy_sell_size_ratio": ratio(ratio(F.col("buy_volume"), b), ratio(F.col("sell_volume"), s)),
        "large_order_count": F.col("large_order_count"), "large_buy_count": F.col("large_buy_count"), "large_sell_count": F.col("large_order_count") - F.col("large_buy_count"),
        "large_order_ratio": F.col("large_order_count") / n, "large_order_buy_ratio": F.col("large_buy_count") / F.col("large_order_count"),
        **{f"{part}_{c}": value for c in CLASSES for part, value in (("buy_ratio", ratio(F.col(f"buys_{c}").cast("double"), F.col(f"count_{c}").cast("double"))), ("buy_volume_ratio", ratio(F.col(f"bought_{c}"), F.col(f"volume_{c}"))))},
    }
    return rows.select(F.col("mint").alias("coin_id"), "sample_us", "window_s", *(c.alias(name) for name, c in out.items()))


def forward_outcomes(pairs: DataFrame, cfg: GridConfig, seconds: Sequence[int] = (60, 300, 600)) -> DataFrame:
    """A row for each sample and window from it on that has trades: (coin_id, sample_us, window_s), volumes, counts, traders,
    net flow, and whether more is bought than sold."""
    rows = in_windows(pairs, cfg, seconds, ahead=True)
    total = lambda on: F.sum(F.when(F.col(on), F.col("sol_amount")).otherwise(0.0))
    whole = rows.groupBy(*KEYS).agg(F.first("sample_us").alias("sample_us"), F.count("*").alias("n"), F.count_if("is_buy").alias("buys"), F.sum("sol_amount").alias("volume"), total("is_buy").alias("bought"), total("is_sell").alias("sold"))
    # a row for each trader, so that distinct ones are a count
    one = in_parts(rows.select(*KEYS, "swapper"), *KEYS).groupBy(*KEYS, "swapper").agg(F.lit(1).alias("one"))
    rows = whole.join(one.groupBy(*KEYS).agg(F.count("*").alias("traders")), list(KEYS))
    flow, v, w = F.col("bought") - F.col("sold"), F.col("volume"), F.col("window_s")
    out = {
        "forward_total_volume": v, "forward_transaction_count": F.col("n"), "forward_unique_traders": F.col("traders"), "forward_buy_ratio": F.col("buys") / F.col("n"),
        "forward_avg_transaction_size": v / F.col("n"), "forward_volume_intensity": v / w, "forward_buy_volume": F.col("bought"), "forward_sell_volume": F.col("sold"), "forward_net_flow": flow,
        "is_profitable_period": flow > 0, "profitability_score": ratio(flow, v), "volume_growth_score": v / w, "trader_growth": F.col("traders") / w,
    }
    return rows.select(F.col("mint").alias("coin_id"), "sample_us", "window_s", *(c.alias(name) for name, c in out.items()))


def with_gap(pairs: DataFrame) -> DataFrame:
    """Add gap_us, the time since the coin's trade before. A coin is dealt in pieces of its trades."""
    rows = places.overlapped(places.numbered(pairs, "mint", "us", ["us", "row_index"]), 1)
    return places.own(rows.withColumn("gap_us", F.col("us") - F.lag("us").over(places.piece("mint")))).drop("place")


#: Keeps a ratio defined where nothing was traded.
TINY = 1e-10


def regime_features(pairs: DataFrame, cfg: GridConfig) -> DataFrame:
    """(coin_id, sample_us) and for each window of the grid 16 features of the market's state, zeros where it has no trades.
    Gaps are those between two trades of the window: one whose earlier trade is before the window doesn't count. Of one gap
    the deviation is null, as that of one trade's amount is."""
    names = {s: name for name, s in cfg.windows}
    rows = in_windows(with_gap(pairs), cfg, list(names))
    amount = F.col("sol_amount")
    gap = F.when(F.col("back_us") + F.col("gap_us") <= F.col("window_s") * SECOND, F.col("gap_us") / float(SECOND))
    sums = {"n": F.count("*"), "volume": F.sum(amount), "bought": F.sum(F.when(F.col("is_buy"), amount).otherwise(0.0)), "sold": F.sum(F.when(F.col("is_sell"), amount).otherwise(0.0)), "buys": F.count_if("is_buy"), "sells": F.count_if("is_sell")}
    sums |= {"std": F.stddev_samp(amount), "gap": F.avg(gap), "gap_std": F.stddev_samp(gap)} | {c: F.count_if(of_class(amount, c)) for c in CLASSES}
    dealt = in_parts(rows.select(*KEYS, "swapper", "is_buy", "is_sell", "sol_amount", "back_us", "gap_us"), *KEYS)
    traders = dealt.groupBy(*KEYS, "swapper").agg(F.lit(1).alias("one")).groupBy(*KEYS).agg(F.count("*").alias("traders"))
    rows = dealt.groupBy(*KEYS).agg(*(v.alias(n) for n, v in sums.items())).join(traders, list(KEYS))
    n, v, u = F.col("n").cast("double"), F.col("volume"), F.col("traders").cast("double")
    features = {
        "total_volume": v, "total_txns": n, "unique_traders": u, "avg_txn_size": v / (n + TINY), "volume_per_trader": v / (u + TINY),
        "buy_ratio": F.col("bought") / (v + TINY), "buy_txn_ratio": F.col("buys") / (n + TINY), "volume_imbalance": (F.col("bought") - F.col("sold")) / (v + TINY), "txn_imbalance": (F.col("buys") - F.col("sells")) / (n + TINY),
        "volume_concentration": F.when(v > 0, F.col("std") / (v / n + TINY)).otherwise(0.0), **{f"{c}_ratio": F.col(c) / n for c in CLASSES},
        "avg_time_between_txns": F.when(n > 1, F.col("gap")).otherwise(0.0), "txn_frequency_volatility": F.when(n > 1, F.col("gap_std")).otherwise(0.0),
    }
    rows = rows.select(*KEYS, F.struct(*(c.alias(name) for name, c in features.items())).alias("f"))
    wide = rows.groupBy("mint", "k").agg(*(F.first(F.when(F.col("window_s") == s, F.col("f")), ignorenulls=True).alias(f"w{s}") for s in names))
    full = sampling_grid(coin_ranges(pairs, cfg), cfg).join(wide, ["mint", "k"], "left")
    columns = [F.when(F.col(f"w{s}").isNull(), 0.0).otherwise(F.col(f"w{s}")[f]).alias(f"{f}_{name}") for s, name in names.items() for f in features]
    return full.select(F.col("mint").alias("coin_id"), "sample_us", *columns)
