"""Operators over swaps: normalisation, prices, bars, and groups by trader, coin and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.functions.columns import is_round_amount, micros, ratio, size_category
from tradeframe.operators import places


def normalise_trades(trades: DataFrame, base: str = "SOL") -> DataFrame:
    """Add is_buy, is_sell, sol_amount (the base leg, 0 without one) and token_amount; us: microseconds."""
    buy, sell = F.col("mint") == F.col("swap_to_mint"), F.col("mint") == F.col("swap_from_mint")
    sol = F.when(buy & (F.col("swap_from_mint") == base), F.col("swap_from_amount")).when(sell & (F.col("swap_to_mint") == base), F.col("swap_to_amount")).otherwise(0.0)
    token = F.when(buy, F.col("swap_to_amount")).when(sell, F.col("swap_from_amount")).otherwise(0.0)
    return trades.withColumns({"is_buy": buy, "is_sell": sell, "sol_amount": sol, "token_amount": token, "us": micros()})


def base_pairs(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """Successful trades of a coin against the base asset."""
    return norm.where(F.col("succeeded") & ((F.col("swap_from_mint") == base) | (F.col("swap_to_mint") == base)) & (F.col("mint") != base))


def with_price(pairs: DataFrame) -> DataFrame:
    """Trades with both legs above 0, and the price of a token."""
    return pairs.where("sol_amount > 0 and token_amount > 0").withColumn("price", F.col("sol_amount") / F.col("token_amount"))


def ohlc(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Bars by keys: first and last price by (time, row), extremes, base-weighted mean, volumes, counts, spread."""
    at = F.struct("us", "row_index")
    return priced.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        (F.sum(F.col("price") * F.col("sol_amount")) / F.sum("sol_amount")).alias("vwap"),
        F.sum("sol_amount").alias("sol_volume"),
        F.sum("token_amount").alias("token_volume"),
        F.count("*").alias("transactions"),
        F.countDistinct("price").alias("unique_prices"),
        F.stddev_samp("price").alias("price_stddev"),
    )


def spent(norm: DataFrame) -> tuple:
    """Base amounts of buys and of sells, null for the other side."""
    return F.when(F.col("is_buy"), F.col("sol_amount")), F.when(F.col("is_sell"), F.col("sol_amount"))


def trader_volume(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """Base asset spent and received by each trader; size and spread of what is spent in a trade."""
    out = F.when(F.col("swap_from_mint") == base, F.col("swap_from_amount"))
    back = F.when(F.col("swap_to_mint") == base, F.col("swap_to_amount"))
    spent_sum, back_sum = (F.coalesce(F.sum(x), F.lit(0.0)) for x in (out, back))
    return norm.groupBy("swapper").agg(
        F.count("*").alias("trades"),
        spent_sum.alias("sol_spent"),
        back_sum.alias("sol_received"),
        F.avg(out).alias("avg_size"),
        F.percentile(out, F.lit(0.5)).alias("median_size"),
        F.coalesce(F.max(out), F.lit(0.0)).alias("max_size"),
        F.min(F.when(out > 0, out)).alias("min_size"),
        F.stddev_samp(out).alias("std_size"),
        F.try_divide(F.stddev_samp(out), F.avg(out)).alias("size_cv"),
        (back_sum - spent_sum).alias("net_sol"),
    )


def trader_diversification(norm: DataFrame) -> DataFrame:
    """Coins of each trader, trades a coin, and the share of the coin traded most. Two steps, one exchange of rows."""
    per_coin = norm.groupBy("swapper", "mint").agg(F.count("*").alias("n"))
    return per_coin.groupBy("swapper").agg(
        F.count("*").alias("coins"),
        F.sum("n").alias("trades"),
        (F.sum("n") / F.count("*")).alias("trades_per_coin"),
        (F.max("n") / F.sum("n")).alias("max_share"),
    )


def trader_timing(norm: DataFrame) -> DataFrame:
    """Span, pace and distinct active hours and days of each trader."""
    hour = F.floor(F.col("us") / 3_600_000_000)
    day = F.floor(F.col("us") / 86_400_000_000)
    span = (F.max("us") - F.min("us")) / 3.6e9
    return norm.groupBy("swapper").agg(
        span.alias("span_hours"),
        F.countDistinct(hour).alias("active_hours"),
        F.countDistinct(day).alias("active_days"),
        F.try_divide(span, F.count("*") - 1).alias("mean_gap_hours"),
        (F.count("*") / F.countDistinct(hour)).alias("trades_per_active_hour"),
    )


def trader_round_numbers(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """Share of round amounts among those that a trader spends of the base asset; null where none are spent."""
    spends = F.col("swap_from_mint") == base
    round_ones = F.count_if(spends & is_round_amount(F.col("swap_from_amount")))
    return norm.groupBy("swapper").agg(F.count_if(spends).alias("base_trades"), round_ones.alias("round_trades"), F.try_divide(round_ones, F.count_if(spends)).alias("round_share"))


def trader_trade_types(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """Trades from the base, to it and between other tokens, and the tokens on either side."""
    src, dst = F.col("swap_from_mint") == base, F.col("swap_to_mint") == base
    return norm.groupBy("swapper").agg(
        F.count_if(src).alias("base_to_token"),
        F.count_if(dst).alias("token_to_base"),
        F.count_if(~src & ~dst).alias("token_to_token"),
        F.countDistinct(F.when(~dst, F.col("swap_to_mint"))).alias("tokens_bought"),
        F.countDistinct(F.when(~src, F.col("swap_from_mint"))).alias("tokens_sold"),
        F.try_divide(F.count_if(src), F.count_if(dst)).alias("buy_sell_ratio"),
    )


def positions(norm: DataFrame) -> DataFrame:
    """Result of each trader in each coin; the return is null where nothing was spent. The result is to nine places: what comes
    back as it was spent is no gain, in whatever order it was summed."""
    out, back = spent(norm)
    rows = norm.groupBy("swapper", "mint").agg(
        F.coalesce(F.sum(out), F.lit(0.0)).alias("sol_spent_on_coin"),
        F.coalesce(F.sum(back), F.lit(0.0)).alias("sol_received_from_coin"),
        F.count_if("is_buy").alias("buy_trades"),
        F.count_if("is_sell").alias("sell_trades"),
        F.count("*").alias("total_coin_trades"),
        ((F.max("us") - F.min("us")) / 3.6e9).alias("hours_active_on_coin"),
    )
    net = F.round(F.col("sol_received_from_coin") - F.col("sol_spent_on_coin"), 9)
    return rows.withColumns({"net_sol_pnl_per_coin": net, "roi_on_coin": F.when(F.col("sol_spent_on_coin") > 0, net / F.col("sol_spent_on_coin"))})


def positions_in_order(norm: DataFrame, order: str = "row_index") -> DataFrame:
    """`positions` whose results have the sign that SQL's unrounded sums give them. Sums of doubles are off by up to their count
    times 2^-53 of what is summed, so the sign of a result that near to 0 hangs on the order of its terms: those positions, and
    those of 0 to nine places, are summed in the order of rows. Their rows alone are sorted."""
    keys, held = ("swapper", "mint"), positions(norm)
    paid, got, net = (F.col(c) for c in ("sol_spent_on_coin", "sol_received_from_coin", "net_sol_pnl_per_coin"))
    moved = F.abs(paid) + F.abs(got)
    near = (moved > 0) & ((net == 0) | (F.abs(got - paid) <= F.col("total_coin_trades") * 2.0**-52 * moved))
    named = lambda df, *more: df.select(*(F.col(k).alias(f"__{k}") for k in keys), *more)
    same = F.col("swapper").eqNullSafe(F.col("__swapper")) & F.col("mint").eqNullSafe(F.col("__mint"))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, back = (F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in spent(norm))
    sums = norm.join(named(held.where(near)), same, "left_semi").select(*keys, order, (back - out).alias("net"))
    last = sums.groupBy(*keys).agg(F.max_by("net", order).alias("__net"))
    rows = held.join(named(last, "__net"), same, "left").withColumn("net_sol_pnl_per_coin", F.coalesce("__net", net))
    return rows.withColumn("roi_on_coin", F.when(paid > 0, net / paid)).drop("__swapper", "__mint", "__net")


def trader_pnl(held: DataFrame) -> DataFrame:
    """Positions of each trader summed up."""
    return held.groupBy("swapper").agg(
        F.count("*").alias("positions"),
        (F.count_if(F.col("net_sol_pnl_per_coin") > 0) / F.count("*")).alias("win_rate"),
        F.avg("net_sol_pnl_per_coin").alias("avg_pnl"),
        F.avg("roi_on_coin").alias("avg_roi"),
        F.try_divide(F.sum("buy_trades"), F.sum("sell_trades")).alias("buy_sell_ratio"),
    )


def coin_pnl(held: DataFrame) -> DataFrame:
    """Positions of each coin summed up."""
    return held.groupBy("mint").agg(F.count("*").alias("traders"), F.sum("net_sol_pnl_per_coin").alias("total_pnl"), F.avg("net_sol_pnl_per_coin").alias("avg_pnl"), F.count_if(F.col("net_sol_pnl_per_coin") > 0).alias("winners"))


def first_n_hours(norm: DataFrame, hours: float) -> DataFrame:
    """Trades in each coin's first hours, the end left out. The coins' first times are joined, so that no window holds a whole coin."""
    start = norm.groupBy("mint").agg(F.min("us").alias("launch_us"))
    return norm.join(start, "mint").where(F.col("us") < F.col("launch_us") + int(hours * 3_600_000_000))


def early_features(norm: DataFrame, hours: float = 2.0, base: str = "SOL") -> DataFrame:
    """What each trader did in each coin's first hours: activity, volume, variety, habits and timing."""
    early = first_n_hours(norm, hours)
    n, size = F.count("*"), F.col("swap_from_amount")
    minutes = (F.max("us") - F.min("us")) / 6e7
    share = lambda condition: F.count_if(condition) / n
    return early.groupBy("swapper", "mint").agg(
        n.alias("trade_count"),
        (n / hours).alias("trades_per_hour"),
        minutes.alias("time_span_minutes"),
        F.sum(size).alias("total_volume_traded"),
        F.avg(size).alias("avg_trade_size"),
        F.when(F.avg(size) > 0, F.stddev_samp(size) / F.avg(size)).otherwise(0.0).alias("trade_size_cv"),
        F.max(size).alias("largest_trade_size"),
        F.when(F.sum(size) > 0, F.max(size) / F.sum(size)).otherwise(0.0).alias("volume_concentration"),
        F.countDistinct(F.concat_ws("|", "swap_from_mint", "swap_to_mint")).alias("unique_trading_pairs"),
        share((F.col("swap_from_mint") == base) | (F.col("swap_to_mint") == base)).alias("sol_involvement_ratio"),
        share(F.col("swap_to_mint") == F.col("mint")).alias("buy_ratio"),
        share(is_round_amount(size)).alias("round_number_ratio"),
        (F.countDistinct(size) / n).alias("trade_size_diversity"),
        F.when((n > 1) & (minutes > 0), minutes * 60 / (n - 1)).otherwise(0.0).alias("avg_seconds_between_trades"),
        ((F.min("us") - F.min("launch_us")) / 6e7).alias("first_trade_minutes"),
    )


def coin_summary(norm: DataFrame) -> DataFrame:
    out, back = spent(norm)
    return norm.groupBy("mint").agg(
        F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), ((F.max("us") - F.min("us")) / 3.6e9).alias("span_hours"),
        F.sum(out).alias("sol_in"), F.sum(back).alias("sol_out"), F.percentile(F.when(F.col("sol_amount") > 0, F.col("sol_amount")), F.lit(0.5)).alias("median_size"),
        F.count_if("is_buy").alias("buys"), F.count_if("is_sell").alias("sells"),
    )


def token_volumes(trades: DataFrame, base: str = "SOL") -> DataFrame:
    """Base volume and counterparts of each coin; rates after it."""
    other = F.when(F.col("mint") == F.col("swap_to_mint"), F.col("swap_from_mint")).otherwise(F.col("swap_to_mint"))
    amount = F.when(F.col("sol_amount") > 0, F.col("sol_amount"))
    return trades.groupBy("mint").agg(
        F.sum(amount).alias("base_volume"), F.avg(amount).alias("avg_base"), F.max(amount).alias("max_base"), F.count(amount).alias("base_trades"),
        F.countDistinct(F.when(other != base, other)).alias("other_tokens"), F.count_if(other != base).alias("other_trades"),
    )


def daily_stats(norm: DataFrame) -> DataFrame:
    return norm.groupBy(F.to_date(F.timestamp_micros("us")).alias("day")).agg(F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.countDistinct("mint").alias("coins"), F.sum("sol_amount").alias("volume"))


def hourly_pattern(norm: DataFrame) -> DataFrame:
    return norm.groupBy((F.floor(F.col("us") / 3_600_000_000) % 24).alias("hour")).agg(F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.sum("sol_amount").alias("volume"))


def pair_stats(norm: DataFrame) -> DataFrame:
    return norm.groupBy("swap_from_mint", "swap_to_mint").agg(F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.avg("swap_from_amount").alias("avg_from"))


def failed_share(norm: DataFrame) -> DataFrame:
    """Trades by outcome and their share of all: the window runs over two rows."""
    return norm.groupBy("succeeded").agg(F.count("*").alias("trades")).withColumn("percent", F.col("trades") * 100.0 / F.sum("trades").over(Window.partitionBy(F.lit(0))))


def summary_stats(norm: DataFrame) -> DataFrame:
    """Counts and sizes of the whole table. Distinct traders and coins are grouped first, sizes counted by value."""
    amount = norm.where("sol_amount > 0")
    kinds = norm.select(F.explode(F.array(F.struct(F.lit("trader").alias("kind"), F.col("swapper").alias("value")), F.struct(F.lit("coin").alias("kind"), F.col("mint").alias("value")))).alias("x")).where("x.value is not null")
    seen = kinds.groupBy("x.kind", "x.value").agg(F.count("*").alias("n")).agg(F.count_if(F.col("kind") == "trader").alias("traders"), F.count_if(F.col("kind") == "coin").alias("coins"))
    counts = places.with_cuts(norm.agg(F.count("*").alias("trades")), seen)
    return places.with_cuts(counts, places.quantiles(amount, [], "sol_amount", {"median_size": 0.5, "p95_size": 0.95}))


def coins_per_trader(norm: DataFrame) -> DataFrame:
    """Traders by number of coins, with the running share; the window runs over a row for each number."""
    per = norm.groupBy("swapper").agg(F.countDistinct("mint").alias("coins")).groupBy("coins").agg(F.count("*").alias("traders"))
    order = Window.partitionBy(F.lit(0)).orderBy("coins")
    return per.withColumn("running_share", F.sum("traders").over(order) / F.sum("traders").over(Window.partitionBy(F.lit(0))))


def size_mix(norm: DataFrame) -> DataFrame:
    return norm.groupBy(size_category(F.col("sol_amount")).alias("size_class")).agg(F.count("*").alias("trades"), F.sum("sol_amount").alias("volume"))


def dedup(trades: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each group of equal rows: that of the least row_index."""
    return trades.groupBy(*columns).agg(F.min("row_index").alias("row_index"), F.count("*").alias("copies"))


def block_flow(priced: DataFrame, ms: int = 100) -> DataFrame:
    """Order flow of each coin's blocks of `ms` milliseconds."""
    at = F.struct("us", "row_index")
    side = F.when(F.col("is_buy"), "B").otherwise("S")
    buy, sell = F.sum(F.when(F.col("is_buy"), F.col("sol_amount")).otherwise(0.0)), F.sum(F.when(F.col("is_sell"), F.col("sol_amount")).otherwise(0.0))
    return priced.groupBy("mint", F.floor(F.col("us") / (ms * 1000)).alias("block")).agg(
        F.count("*").alias("trades"), (F.max("us") - F.min("us")).alias("duration_us"), buy.alias("buy_volume"), sell.alias("sell_volume"),
        ratio(buy - sell, buy + sell).alias("imbalance"), F.min_by(side, at).alias("first_side"), F.max_by(side, at).alias("last_side"),
        F.countDistinct("swapper").alias("traders"), F.min_by("price", at).alias("price_start"), F.max_by("price", at).alias("price_end"),
    )


def block_sequences(priced: DataFrame, ms: int = 100) -> DataFrame:
    """The sides of each block's trades in order, and patterns in them."""
    side = F.when(F.col("is_buy"), "B").otherwise("S")
    rows = priced.groupBy("mint", F.floor(F.col("us") / (ms * 1000)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("us", "row_index", side.alias("side")))).alias("seq"))
    text = F.array_join(F.transform("seq", lambda x: x["side"]), "")
    return rows.select("mint", "block", text.alias("sequence")).withColumns({"alternating": ~F.col("sequence").contains("BB") & ~F.col("sequence").contains("SS") & (F.length("sequence") > 1), "has_bbb": F.col("sequence").contains("BBB"), "has_sss": F.col("sequence").contains("SSS")})


def gap_profile(norm: DataFrame) -> DataFrame:
    """Seconds between a coin's trades: quantiles and speed bands. Days are dealt apart; each day's first trade looks back to the day before."""
    day = F.floor(F.col("us") / 86_400_000_000)
    rows = norm.select("mint", "us", "row_index", day.alias("day"))
    ends = rows.groupBy("mint", "day").agg(F.max("us").alias("end_us"))
    earlier = ends.withColumn("carried", F.lag("end_us").over(Window.partitionBy("mint").orderBy("day"))).drop("end_us")
    order = Window.partitionBy("mint", "day").orderBy("us", "row_index")
    gaps = rows.join(earlier, ["mint", "day"]).withColumn("gap", (F.col("us") - F.coalesce(F.lag("us").over(order), "carried")) / 1e6).where("gap is not null")
    return gaps.groupBy("mint").agg(F.count("*").alias("gaps"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.percentile("gap", F.lit(0.95)).alias("p95_gap"), F.count_if(F.col("gap") < 60).alias("under_minute"), F.count_if(F.col("gap") >= 3600).alias("over_hour"))
