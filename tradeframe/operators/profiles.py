"""Whole tables about traders, coins and blocks, and money by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.functions.columns import is_round_amount
from tradeframe.operators import places
from tradeframe.operators.samples import with_gap

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def trader_profile(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """A row a trader with all of its features: base volume, sizes, coins, timing, round amounts and kinds of trades.

    One pass of sums, and one in which what is counted once (coins, hours, days, tokens on either side) is grouped by
    trader, kind and value first; both end up dealt by trader, so joining them moves nothing."""
    src, dst = F.col("swap_from_mint") == base, F.col("swap_to_mint") == base
    out, back = F.when(src, F.col("swap_from_amount")), F.when(dst, F.col("swap_to_amount"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n, other = F.count("*"), ~src & ~dst
    span = F.max("us") - F.min("us")
    sums = norm.groupBy("swapper").agg(
        n.alias("trades"), zero(F.sum(out)).alias("sol_spent"), zero(F.sum(back)).alias("sol_received"), F.avg(out).alias("avg_size"), F.percentile(out, F.lit(0.5)).alias("median_size"),
        zero(F.max(out)).alias("max_size"), F.min(F.when(out > 0, out)).alias("min_size"), F.stddev_samp(out).alias("std_size"), F.try_divide(F.stddev_samp(out), F.avg(out)).alias("size_cv"),
        (zero(F.sum(back)) - zero(F.sum(out))).alias("net_sol"), span.alias("__span"), F.count_if(src).alias("sol_to_token_trades"), F.count_if(dst).alias("token_to_sol_trades"), F.count_if(other).alias("token_to_token_trades"),
        F.try_divide(F.count_if(src & is_round_amount(F.col("swap_from_amount"))), F.count_if(src)).alias("round_number_preference"),
    )
    kinds = {"coin": F.col("mint"), "hour": F.floor(F.col("us") / HOUR_US).cast("string"), "day": F.floor(F.col("us") / DAY_US).cast("string"), "from": F.when(~src, F.col("swap_from_mint")), "to": F.when(~dst, F.col("swap_to_mint"))}
    long = norm.select("swapper", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))).alias("x")).where("x.value is not null")
    counted = long.groupBy("swapper", "x.kind", "x.value").agg(F.count("*").alias("n"))
    of = lambda k: F.count_if(F.col("kind") == k)
    distinct = counted.groupBy("swapper").agg(of("coin").alias("unique_coins_traded"), F.max(F.when(F.col("kind") == "coin", F.col("n"))).alias("__most"), of("hour").alias("active_hours"), of("day").alias("active_days"), of("from").alias("unique_from_tokens_non_sol"), of("to").alias("unique_to_tokens_non_sol"))
    rows = sums.join(distinct, "swapper", "left")
    trades, percent = F.col("trades"), lambda c: F.col(c) * 100.0 / F.col("trades")
    return rows.withColumns({
        "avg_trades_per_coin": F.try_divide(trades, F.col("unique_coins_traded")), "trade_concentration_ratio": F.col("__most") / trades, "trading_span_days": F.col("__span") / float(DAY_US),
        "trades_per_day": F.try_divide(trades, F.col("__span") / float(DAY_US)), "avg_hours_between_trades": F.try_divide(F.col("__span") / float(HOUR_US), trades - 1), "trades_per_active_hour": F.try_divide(trades, F.col("active_hours")),
        **{f"{k}_percentage": percent(f"{k}_trades") for k in ("sol_to_token", "token_to_sol", "token_to_token")}, "buy_sell_ratio": F.try_divide(F.col("sol_to_token_trades"), F.col("token_to_sol_trades")),
    }).drop("__span", "__most")


def trader_total_pnl(held: DataFrame) -> DataFrame:
    """(swapper, total_pnl, coins_traded, profitable_coins, best, worst, is_profitable) over a trader's positions in all coins;
    the total is to nine places, so one of 0 is no gain. Where all of a trader's positions cancel out, the sign of what is left
    of their sums decides, as in SQL."""
    net = F.col("net_sol_pnl_per_coin")
    total = F.sum(net)
    gain = F.when(F.max(F.abs(net)) < 5e-10, total > 0).otherwise(F.round(total, 9) > 0)
    return held.groupBy("swapper").agg(F.round(total, 9).alias("total_pnl"), F.count("*").alias("coins_traded"), F.count_if(net > 0).alias("profitable_coins"), F.max(net).alias("best"), F.min(net).alias("worst"), gain.alias("is_profitable"))


def coin_profile(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """A row a coin: counts, span, base asset in and out with mean and median of a trade (0 without any), net flow, and
    trades and traders an hour (0 without a span)."""
    buy, sell = F.col("is_buy") & (F.col("swap_from_mint") == base), F.col("is_sell") & (F.col("swap_to_mint") == base)
    paid, got = F.when(buy, F.col("swap_from_amount")), F.when(sell, F.col("swap_to_amount"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    by_trader = norm.groupBy("mint", "swapper").agg(F.lit(1).alias("one")).groupBy("mint").agg(F.count("*").alias("unique_traders"))
    rows = norm.groupBy("mint").agg(
        F.count("*").alias("total_transactions"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), ((F.max("us") - F.min("us")) / float(HOUR_US)).alias("time_span_hours"),
        F.count_if("is_buy").alias("buy_transactions"), F.count_if("is_sell").alias("sell_transactions"), (F.count_if("is_buy") / F.greatest(F.count_if("is_sell"), F.lit(1))).alias("buy_sell_ratio"),
        zero(F.sum(paid)).alias("total_sol_in"), zero(F.sum(got)).alias("total_sol_out"), zero(F.avg(paid)).alias("avg_sol_per_buy"), zero(F.avg(got)).alias("avg_sol_per_sell"),
        (zero(F.sum(paid)) - zero(F.sum(got))).alias("net_sol_flow"),
    )
    middle = lambda on, amount, name: places.quantiles(norm.where(on).select("mint", F.col(amount).alias("v")), ["mint"], "v", {name: 0.5})
    rows = rows.join(by_trader, "mint").join(middle(buy, "swap_from_amount", "med_sol_per_buy"), "mint", "left").join(middle(sell, "swap_to_amount", "med_sol_per_sell"), "mint", "left").fillna(0.0, ["med_sol_per_buy", "med_sol_per_sell"])
    hourly = lambda c: zero(F.try_divide(F.col(c), F.col("time_span_hours")))
    return rows.withColumns({"txns_per_hour": hourly("total_transactions"), "traders_per_hour": hourly("unique_traders")})


def token_volume_table(norm: DataFrame, base: str = "SOL") -> DataFrame:
    """A row a coin: trades, traders, successful trades, base volume and its mean and greatest over successful ones, trades
    of pairs with the base and without, and how many tokens it was traded against."""
    src, dst = F.col("swap_from_mint") == base, F.col("swap_to_mint") == base
    amount = F.when(F.col("succeeded") & src, F.col("swap_from_amount")).when(F.col("succeeded") & dst, F.col("swap_to_amount"))
    other = F.when(F.col("swap_from_mint") == F.col("mint"), F.col("swap_to_mint")).when(F.col("swap_to_mint") == F.col("mint"), F.col("swap_from_mint"))
    kinds = norm.select("mint", F.explode(F.array(F.struct(F.lit("trader").alias("kind"), F.col("swapper").alias("value")), F.struct(F.lit("pair").alias("kind"), other.alias("value")))).alias("x")).where("x.value is not null")
    distinct = kinds.groupBy("mint", "x.kind", "x.value").agg(F.lit(1).alias("one")).groupBy("mint").agg(F.count_if(F.col("kind") == "trader").alias("unique_traders"), F.count_if(F.col("kind") == "pair").alias("unique_pairs"))
    rows = norm.groupBy("mint").agg(
        F.count("*").alias("total_trades"), F.count_if("succeeded").alias("successful_trades"), F.sum(F.coalesce(amount, F.lit(0.0))).alias("total_sol_volume"), F.avg(amount).alias("avg_sol_per_trade"),
        F.max(F.coalesce(amount, F.lit(0.0))).alias("max_sol_trade"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_if(other == base).alias("sol_pair_trades"), F.count_if(other != base).alias("non_sol_pair_trades"),
    )
    return rows.join(distinct, "mint", "left").fillna(0, ["unique_traders", "unique_pairs"])


def block_detail(pairs: DataFrame, ms: int = 100, least: int = 2) -> DataFrame:
    """A row for each block of `ms` milliseconds with `least` trades and some volume: flow, imbalances with their band, first and
    last side, sizes, and prices at both ends, extreme, their variation (0 of one price) and change."""
    at = F.struct("us", "row_index")
    amount, buy, sell = F.col("sol_amount"), F.col("is_buy"), F.col("is_sell")
    price = F.when((amount > 0) & (F.col("token_amount") > 0), amount / F.col("token_amount"))
    total = lambda on: F.sum(F.when(on, amount).otherwise(0.0))
    first, last = F.min_by(price, F.when(price.isNotNull(), at)), F.max_by(price, F.when(price.isNotNull(), at))
    several = F.count(price) > 1
    rows = pairs.groupBy("mint", F.floor(F.col("us") / (ms * 1000)).alias("block")).agg(
        F.count("*").alias("block_size"), ((F.max("us") - F.min("us")) / 1000).alias("duration_ms"), F.sum(amount).alias("total_volume"), F.count_if(buy).alias("buy_count"), F.count_if(sell).alias("sell_count"),
        total(buy).alias("buy_volume"), total(sell).alias("sell_volume"), F.min_by(buy, at).alias("first_txn_is_buy"), F.max_by(buy, at).alias("last_txn_is_buy"), F.avg(amount).alias("avg_txn_size"), F.max(amount).alias("largest_txn"),
        first.alias("price_start"), last.alias("price_end"), F.min(price).alias("price_min"), F.max(price).alias("price_max"), F.when(several & (F.avg(price) > 0), F.stddev_samp(price) / F.avg(price)).when(F.count(price) > 0, 0.0).alias("price_volatility"),
        F.when(several & (first > 0), (last - first) / first).when(F.count(price) > 0, 0.0).alias("price_change"),
    ).where((F.col("block_size") >= least) & (F.col("total_volume") > 0))
    flow = (F.col("buy_count") - F.col("sell_count")) / F.col("block_size")
    band = F.when(flow > 0.5, "strong buy").when(flow > 0.1, "moderate buy").when(flow >= -0.1, "balanced").when(flow >= -0.5, "moderate sell").otherwise("strong sell")
    return rows.withColumns({
        "flow_imbalance": flow, "volume_imbalance": (F.col("buy_volume") - F.col("sell_volume")) / F.col("total_volume"), "imbalance_band": band,
        "dominant_direction": F.when(F.col("buy_count") > F.col("sell_count"), "buy").otherwise("sell"), "size_concentration": F.col("largest_txn") / F.col("total_volume"),
    })


def block_sequences(pairs: DataFrame, ms: int = 100, least: int = 3) -> DataFrame:
    """(mint, block, sides, sizes, moves and flags) of blocks with `least` trades and some volume: sides as B and S, sizes as L
    over the block's mean and S, moves of the price as U, D and F (null under two prices), and which patterns the sides
    hold. A block's trades are in one row, as the sequence is."""
    amount = F.col("sol_amount")
    price = F.when((amount > 0) & (F.col("token_amount") > 0), amount / F.col("token_amount"))
    rows = pairs.groupBy("mint", F.floor(F.col("us") / (ms * 1000)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("us", "row_index", F.col("is_buy").alias("buy"), amount.alias("size"), price.alias("price")))).alias("seq"), F.avg(amount).alias("mean"), F.sum(amount).alias("volume"))
    rows = rows.where((F.size("seq") >= least) & (F.col("volume") > 0))
    prices = F.filter(F.transform("seq", lambda x: x["price"]), lambda p: p.isNotNull())
    rows = rows.select("mint", "block", "mean", "seq", prices.alias("prices"))
    text = lambda c: F.array_join(c, "")
    moves = F.transform(F.slice("prices", F.lit(2), F.greatest(F.size("prices") - 1, F.lit(0))), lambda p, i: F.when(p > F.get(F.col("prices"), i), "U").when(p < F.get(F.col("prices"), i), "D").otherwise("F"))
    rows = rows.select("mint", "block", text(F.transform("seq", lambda x: F.when(x["buy"], "B").otherwise("S"))).alias("sides"), text(F.transform("seq", lambda x: F.when(x["size"] > F.col("mean"), "L").otherwise("S"))).alias("sizes"), F.when(F.size("prices") >= 2, text(moves)).alias("moves"))
    s = F.col("sides")
    flags = {"alternating": ~s.contains("BB") & ~s.contains("SS") & (F.length(s) >= 4), "clustered_buys": s.contains("BBB"), "clustered_sells": s.contains("SSS"), "sandwich_buy": s.contains("BSB"), "sandwich_sell": s.contains("SBS"), "momentum_buy": s.endswith("BB"), "momentum_sell": s.endswith("SS")}
    return rows.withColumns(flags)


def pattern_counts(sequences: DataFrame, column: str = "sides", most: int = 10) -> DataFrame:
    """(pattern, blocks, percent): the patterns that most blocks have, of equals the first by name. Patterns are counted before
    they are ordered."""
    counted = sequences.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("pattern")).agg(F.count("*").alias("blocks"))
    whole = places.with_cuts(counted, counted.agg(F.sum("blocks").alias("__all")))
    return whole.withColumn("percent", F.col("blocks") * 100.0 / F.col("__all")).drop("__all").orderBy(F.col("blocks").desc(), "pattern").limit(most)


#: Speed bands of gaps in seconds: over the first, up to the second.
BANDS = {"very_fast": (None, 1), "fast": (1, 5), "normal": (5, 30), "slow": (30, 300), "very_slow": (300, None)}


def gap_statistics(pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """A row a coin of the seconds between its trades: extremes, mean, deviation, seven percentiles, and how many and what
    share are in each of five speed bands. `scale` stretches the bands."""
    gaps = with_gap(pairs).where("gap_us is not null").select("mint", (F.col("gap_us") / 1e6).alias("gap"))
    g = F.col("gap")

    def inside(low: float | None, high: float | None) -> Column:
        return (F.lit(True) if low is None else g > low * scale) & (F.lit(True) if high is None else g <= high * scale)

    stats = gaps.groupBy("mint").agg(F.count("*").alias("gaps"), F.min(g).alias("min_gap"), F.max(g).alias("max_gap"), F.avg(g).alias("mean_gap"), F.stddev_samp(g).alias("std_gap"), *(F.count_if(inside(*b)).alias(name) for name, b in BANDS.items()))
    points = places.quantiles(gaps, ["mint"], "gap", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90, 95, 99)})
    return stats.join(points, "mint").withColumns({f"{name}_share": F.col(name) / F.col("gaps") for name in BANDS})


def whale_regime(features: DataFrame, short: str = "30s", long: str = "60s", per_trader: float = 50.0, whales: float = 0.002, size: float = 4.0) -> DataFrame:
    """Add market_regime to rows of window features: whale activity where volume a trader, the share of whale trades and the mean
    trade are all over their bounds."""
    busy = (F.col(f"volume_per_trader_{long}") > per_trader) & (F.col(f"whale_txn_ratio_{short}") > whales) & (F.col(f"avg_txn_size_{long}") > size)
    return features.withColumn("market_regime", F.when(busy, "REGIME_2_WHALE_ACTIVITY").otherwise("NORMAL_TRADING"))


def profit_sweep(scored: DataFrame, percents: Sequence[int] = range(10, 95, 5), by: Sequence[str] = ()) -> DataFrame:
    """(by..., percent, total_trades, trade_rate, avg_profit, total_profit, win_rate, avg_win, avg_loss, profit_factor,
    sharpe_ratio) of taking the samples with `score >= percent / 100`, whose profit is what is bought less what is sold
    after; thresholds that none reaches have no row. profit_factor is 0 where nothing is lost, averages and the ratio are 0
    where there is nothing to average or no deviation.

    Samples are summed by how many thresholds they reach; thresholds are sums of those few rows, deviations merged about
    their means."""
    pnl = F.col("forward_buy") - F.col("forward_sell")
    reached = sum((F.when(F.col("score") >= p / 100.0, 1).otherwise(0) for p in percents), F.lit(0))
    wins = pnl > 0
    by = list(by)
    buckets = scored.groupBy(*by, reached.alias("reached")).agg(F.count("*").alias("n"), F.avg(pnl).alias("mean"), (F.var_pop(pnl) * F.count(pnl)).alias("spread"), F.count_if(wins).alias("wins"), F.sum(F.when(wins, pnl).otherwise(0.0)).alias("won"), F.sum(F.when(~wins, pnl).otherwise(0.0)).alias("lost"))
    all_n = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    names = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(p).alias("percent")) for i, p in enumerate(percents)))
    each = buckets.withColumn("all", F.sum("n").over(all_n)).withColumn("t", F.explode(names)).where(F.col("reached") >= F.col("t.i"))
    key = [*by, "percent"]
    each = each.withColumn("percent", F.col("t.percent"))
    whole = Window.partitionBy(*key)
    each = each.withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    out = each.groupBy(*key).agg(F.sum("n").alias("total_trades"), F.first("all").alias("all"), F.first("centre").alias("avg_profit"), F.sum(F.col("spread") + F.col("n") * (F.col("mean") - F.col("centre")) ** 2).alias("spread"), *(F.sum(c).alias(c) for c in ("wins", "won", "lost")))
    n, zero = F.col("total_trades"), lambda c: F.coalesce(c, F.lit(0.0))
    std = F.sqrt(F.try_divide(F.col("spread"), n - 1))
    return out.select(
        *key, "total_trades", (n / F.col("all")).alias("trade_rate"), "avg_profit", (F.col("won") + F.col("lost")).alias("total_profit"), (F.col("wins") / n).alias("win_rate"),
        zero(F.try_divide(F.col("won"), F.col("wins"))).alias("avg_win"), zero(F.try_divide(F.col("lost"), n - F.col("wins"))).alias("avg_loss"), zero(F.abs(F.try_divide(F.col("won"), F.col("lost")))).alias("profit_factor"),
        zero(F.try_divide(F.col("avg_profit"), std)).alias("sharpe_ratio"),
    )


def score_bin_profits(scored: DataFrame, low: float = 0.1, high: float = 0.2, bins: int = 10, outlier: float = 0.95) -> DataFrame:
    """(bin, from_score, to_score, n, mean_pnl, median_pnl, std_pnl, outliers, outlier_share) of score bins of equal width from
    `low` up to `high`, the end left out: profits, and how many are larger either way than the `outlier` quantile of their
    sizes over the whole range, its end included."""
    edges = [low + (high - low) * i / bins for i in range(bins + 1)]
    rows = scored.where(F.col("score").between(low, high)).select("score", (F.col("forward_buy") - F.col("forward_sell")).alias("pnl"))
    rows = rows.withColumns({"size": F.abs("pnl"), "bin": sum((F.when(F.col("score") >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))})
    rows = places.with_cuts(rows, places.quantiles(rows, [], "size", {"cut": outlier})).where(F.col("bin") < bins)
    stats = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean_pnl"), F.stddev_samp("pnl").alias("std_pnl"), F.count_if(F.col("size") > F.col("cut")).alias("outliers"))
    at = lambda i: F.get(F.array(*map(F.lit, edges)), i)
    out = stats.join(places.quantiles(rows, ["bin"], "pnl", {"median_pnl": 0.5}), "bin")
    return out.select("bin", at(F.col("bin")).alias("from_score"), at(F.col("bin") + 1).alias("to_score"), "n", "mean_pnl", "median_pnl", "std_pnl", "outliers", (F.col("outliers") / F.col("n")).alias("outlier_share"))


def with_time_bin(scored: DataFrame, minutes: float = 5.0) -> DataFrame:
    """Add time_bin: which stretch of `minutes` since its coin's first sample a sample is in. First times are a table of a row a coin."""
    first = scored.groupBy("coin_id").agg(F.min("sample_us").alias("__first"))
    return scored.join(first, "coin_id").withColumn("time_bin", F.floor((F.col("sample_us") - F.col("__first")) / (minutes * 6e7))).drop("__first")
