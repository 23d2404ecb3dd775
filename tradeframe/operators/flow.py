"""Order flow: signals of blocks, how flow and prices go together, and what signals were followed by."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tradeframe.functions.columns import ratio
from tradeframe.operators.places import numbered, overlapped, own, pair_corr, piece, quantiles, with_cuts
from tradeframe.operators.studies import next_prices
from tradeframe.operators.windows import in_parts
from tradeframe.sources.written import written

#: Signals that are on or off: they have no sell side of their own.
FLAGS = ("clustered_buys", "clustered_sells", "momentum_buys", "momentum_sells", "strong_buy_signal", "strong_sell_signal")
SIGNALS = ("flow_imbalance", "volume_imbalance", "buy_ratio", *FLAGS, "size_concentration", "trader_concentration", "large_buy_ratio", "momentum_signal", "imbalance_strength")


def block_signals(pairs: DataFrame, ms: int = 100, least: int = 3, strong: float = 0.3, large: float = 0.8) -> DataFrame:
    """Signals of each coin's blocks of `least` trades or more with volume and a price: imbalances, runs of three sides,
    the last two sides, concentration, and the share of buys among trades of the block's `large` quantile or more.
    A block's trades are one row's array: a block is a short stretch of time."""
    amount, priced = F.col("sol_amount"), (F.col("sol_amount") > 0) & (F.col("token_amount") > 0)
    trade = F.struct("us", "row_index", F.when(F.col("is_buy"), "B").otherwise("S").alias("side"), "sol_amount")
    rows = pairs.groupBy("mint", F.floor(F.col("us") / (ms * 1000)).alias("block")).agg(
        F.min("us").alias("us"), F.count("*").alias("block_size"), F.sum("sol_amount").alias("total_volume"), F.max("sol_amount").alias("__most"), F.countDistinct("swapper").alias("__traders"),
        F.min_by(F.when(priced, amount / F.col("token_amount")), F.when(priced, F.struct("us", "row_index"))).alias("price"), F.count_if("is_buy").alias("__buys"), F.count_if("is_sell").alias("__sells"),
        F.sum(F.when(F.col("is_buy"), amount).otherwise(0.0)).alias("__bought"), F.sum(F.when(F.col("is_sell"), amount).otherwise(0.0)).alias("__sold"),
        F.percentile("sol_amount", F.lit(large)).alias("__cut"), F.sort_array(F.collect_list(trade)).alias("__seq"),
    ).where((F.col("block_size") >= least) & (F.col("total_volume") > 0) & F.col("price").isNotNull())
    sides = F.array_join(F.transform("__seq", lambda x: x["side"]), "")
    rows = rows.withColumns({"__sides": sides, "__large": F.filter("__seq", lambda x: x["sol_amount"] >= F.col("__cut"))})
    n, flow = F.col("block_size").cast("double"), (F.col("__buys") - F.col("__sells")) / F.col("block_size")
    on = lambda c: c.cast("int")
    text = F.col("__sides")
    bbb, sss, bb, ss = text.contains("BBB"), text.contains("SSS"), text.endswith("BB"), text.endswith("SS")
    return rows.select(
        "mint", "block", "us", "block_size", "total_volume", "price", flow.alias("flow_imbalance"), ((F.col("__bought") - F.col("__sold")) / F.col("total_volume")).alias("volume_imbalance"), (F.col("__buys") / n).alias("buy_ratio"),
        on(bbb).alias("clustered_buys"), on(sss).alias("clustered_sells"), on(bb).alias("momentum_buys"), on(ss).alias("momentum_sells"), (F.col("__most") / F.col("total_volume")).alias("size_concentration"),
        (F.col("__traders") / n).alias("trader_concentration"), (F.size(F.filter("__large", lambda x: x["side"] == "B")) / F.size("__large")).alias("large_buy_ratio"),
        on((flow > strong) & bbb).alias("strong_buy_signal"), on((flow < -strong) & sss).alias("strong_sell_signal"), (on(bb) - on(ss)).alias("momentum_signal"), F.abs(flow).alias("imbalance_strength"),
    )


def signed_moves(priced: DataFrame, behind: int, ahead: int = 0) -> DataFrame:
    """A coin's priced trades in overlapping pieces, with the signed volume and the price's change."""
    rows = in_parts(overlapped(numbered(priced, "mint", "us", ["us", "row_index"]), behind, ahead), "mint", "__piece")
    before = F.lag("price").over(piece("mint"))
    return rows.withColumns({"signed": F.when(F.col("is_buy"), F.col("sol_amount")).otherwise(-F.col("sol_amount")), "change": F.col("price") - before, "r": F.try_divide(F.col("price"), before) - 1})


def last_rows(width: str, widths: Sequence[int]) -> WindowSpec:
    """The last `width` rows of a piece, a column with one of `widths` for the whole coin. Places are stretched so that one
    range of them is that many rows at each width: the frame is worked out once and not for each of the widths."""
    span = math.lcm(*widths)
    return Window.partitionBy("mint", "__piece").orderBy(F.col("place") * (F.lit(span) / F.col(width)).cast("long")).rangeBetween(1 - span, 0)


def rolling_corr(x: str, y: str, over: WindowSpec, width: str) -> Column:
    """Correlation over a frame of `width` rows; null where a value is missing."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return F.when(F.count(both).over(over) == F.col(width), pair_corr(x, y, over))


def flow_toxicity(priced: DataFrame, least: int = 20, shortest: int = 5, longest: int = 10) -> DataFrame:
    """For each coin of `least` priced trades or more: how signed volume goes with the price's change over rolling
    frames (a quarter of the coin's trades, `longest` at most), price impact a volume, and sums of flow."""
    counts = priced.groupBy("mint").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = signed_moves(priced.join(counts, "mint"), longest).withColumn("width", F.least(F.lit(longest), F.floor(F.col("n") / 4)).cast("int")).where(F.col("width") >= shortest)
    w = last_rows("width", range(shortest, longest + 1))
    spread = F.when(F.count("change").over(w) == F.col("width"), F.stddev_samp("change").over(w))
    rows = own(rows.withColumns({"__r": rolling_corr("signed", "change", w, "width"), "__impact": F.try_divide(spread, F.avg(F.abs("signed")).over(w))}))
    price, size = F.col("price"), F.col("sol_amount")
    return rows.groupBy("mint").agg(
        F.count("*").alias("total_transactions"), ((F.max("us") - F.min("us")) / 3.6e9).alias("time_span_hours"), F.avg(price).alias("avg_price"), F.stddev_samp("r").alias("price_volatility"),
        ((F.max(price) - F.min(price)) / F.avg(price)).alias("price_range_pct"), F.sum(size).alias("total_volume"), F.avg(size).alias("avg_trade_size"), (F.max(size) / F.sum(size)).alias("volume_concentration"),
        F.sum("signed").alias("net_flow"), (F.sum("signed") / F.sum(size)).alias("flow_imbalance"), F.avg(F.col("is_buy").cast("int")).alias("buy_ratio"), F.avg("__r").alias("avg_flow_price_corr"),
        F.stddev_samp("__r").alias("flow_price_corr_volatility"), F.avg("__impact").alias("kyle_lambda_proxy"), pair_corr(price, size).alias("price_volume_corr"), pair_corr(F.col("r"), size).alias("return_volume_corr"),
        F.abs(F.avg("__r")).alias("informed_trading_proxy"),
    )


def toxicity_classes(toxicity: DataFrame) -> DataFrame:
    """Coins by quartiles of their mean correlation of flow and price."""
    r = F.col("avg_flow_price_corr")
    # worked out once: a mean made anew in another order can be above the cut that it is
    toxicity = written(toxicity, "toxicity")
    cut = with_cuts(toxicity, quantiles(toxicity, [], "avg_flow_price_corr", {"__q25": 0.25, "__q75": 0.75}))
    label = F.when(r > F.col("__q75"), "High Toxicity").when(r > F.col("__q25"), "Medium Toxicity").when(r.isNotNull(), "Low Toxicity").otherwise("Unknown")
    return cut.withColumn("toxicity_category", label).drop("__q25", "__q75")


def lead_lag(priced: DataFrame, least: int = 100, factor: float = 1.5) -> DataFrame:
    """For each coin of `least` priced trades or more: how flow goes with the next change of price, the change with the
    next flow, and the absolute change with the next volume; which of the first two is `factor` times the other."""
    enough = priced.groupBy("mint").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    rows = signed_moves(priced.join(enough, "mint"), 2)
    last = lambda c: F.lag(c).over(piece("mint"))
    rows = own(rows.withColumns({"__flow": F.when(F.col("place") >= 2, last("signed")), "__change": last("change")}))
    out = rows.groupBy("mint").agg(
        (F.count("*") - 1).alias("data_points"), pair_corr(F.col("__flow"), F.col("change")).alias("flow_predicts_price"), pair_corr(F.col("__change"), F.col("signed")).alias("price_predicts_flow"),
        pair_corr(F.abs("__change"), F.col("sol_amount")).alias("momentum_correlation"),
    )
    flow, price = F.abs("flow_predicts_price"), F.abs("price_predicts_flow")
    return out.withColumn("interpretation", F.when(flow > price * factor, "Information-driven").when(price > flow * factor, "FOMO-driven").otherwise("Mixed"))


def integrate_flow(blocks: DataFrame, toxicity: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blocks with their coin's toxicity; blocks of other coins are left out. Spark picks the join by the sizes."""
    return blocks.join(toxicity.select("mint", *columns), "mint")


def with_forward_returns(signals: DataFrame, seconds: Sequence[int], bucket_us: int) -> DataFrame:
    """(signal columns, horizon, ret): the change to the first block's price at or after each horizon."""
    prices = next_prices(signals.select("mint", "us", "price", F.col("block").alias("row_index")), seconds, bucket_us)
    found = prices.where("next_price is not null").select("mint", "us", "horizon", (F.try_divide(F.col("next_price"), F.col("price")) - 1).alias("ret"))
    return signals.join(found, ["mint", "us"])


def signal_performance(returns: DataFrame, signals: Sequence[str] = SIGNALS, threshold: float | None = None) -> DataFrame:
    """What followed each signal at each horizon: hits, mean, deviation and their ratio where it says buy, where it says
    sell and between. Without a threshold a flag says buy where it is 1, any other signal in its upper quarter, and
    sell where it is 0 or in its lower quarter."""
    long = returns.select("horizon", "ret", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("x"))
    long = long.select("horizon", "ret", "x.signal", "x.value").where("ret is not null and value is not null")
    if threshold is None:
        # worked out once: sums made anew in another order would miss the cut that they were
        long = written(long, "signals")
        cuts = quantiles(long, ["horizon", "signal"], "value", {"__low": 0.25, "__high": 0.75})
        flag = F.col("signal").isin(*FLAGS)
        long = with_cuts(long, cuts, ["horizon", "signal"])
        buy, sell = F.when(flag, F.col("value") == 1).otherwise(F.col("value") >= F.col("__high")), F.when(flag, F.col("value") == 0).otherwise(F.col("value") <= F.col("__low"))
    else:
        buy, sell = F.col("value") >= threshold, F.col("value") <= -threshold
    ret = F.col("ret")
    up, down, rest = F.when(buy, ret), F.when(sell, ret), F.when(~(buy | sell), ret)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return long.groupBy("signal", "horizon").agg(
        F.count("*").alias("total_observations"), F.count(up).alias("buy_signals"), ratio(F.count_if(up > 0), F.count(up)).alias("buy_hit_rate"), zero(F.avg(up)).alias("buy_avg_return"), zero(F.stddev_samp(up)).alias("buy_return_std"),
        F.count(down).alias("sell_signals"), ratio(F.count_if(down < 0), F.count(down)).alias("sell_hit_rate"), zero(F.avg(down)).alias("sell_avg_return"), zero(F.stddev_samp(down)).alias("sell_return_std"),
        F.count(rest).alias("neutral_signals"), zero(F.avg(rest)).alias("neutral_avg_return"), ratio(F.avg(up), F.stddev_samp(up)).alias("buy_sharpe"), ratio(F.abs(F.avg(down)), F.stddev_samp(down)).alias("sell_sharpe"),
    )
