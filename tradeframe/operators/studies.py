"""Scored samples, forward prices, execution checks and daily frames, as set-based operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.operators.places import in_pieces

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def next_prices(quotes: DataFrame, horizons: Sequence[int], bucket_us: int = DAY, asked: DataFrame | None = None) -> DataFrame:
    """(mint, us, horizon, price, next_us, next_price): for each quote and horizon in seconds the first quote of the coin
    at or after that time; null where there is none. Of quotes at one time the one of least row_index counts. With `asked` (mint, us) it is
    worked out for these times instead, and price is null where no quote is at one.

    Quotes are dealt by coin and stretch of time, so that no coin is one task; where a stretch has no later quote, the
    first one of the next stretch that has any is taken from a table of a row a stretch."""
    quotes = quotes.groupBy("mint", "us").agg(F.min_by("price", "row_index").alias("price"))
    stretch = lambda us: F.floor(us / bucket_us)
    times = quotes if asked is None else asked.select("mint", "us").distinct().join(quotes, ["mint", "us"], "left")
    asked = times.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("at", F.col("us") + F.col("horizon").cast("long") * SECOND)
    offered = quotes.select("mint", F.lit(None).cast("long").alias("us"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("int").alias("horizon"), F.col("us").alias("at"), F.struct("us", "price").alias("quote"))
    rows = asked.withColumn("quote", F.lit(None).cast(offered.schema["quote"].dataType)).unionByName(offered).withColumn("stretch", stretch(F.col("at")))
    later = Window.partitionBy("mint", "stretch").orderBy(F.col("at").desc(), F.col("quote").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("near", F.last("quote", ignorenulls=True).over(later)).where("horizon is not null")
    firsts = rows.groupBy("mint", "stretch").agg(F.min("quote").alias("first"))
    after = Window.partitionBy("mint").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("mint", "stretch", F.last("first", ignorenulls=True).over(after).alias("far"))
    best = F.coalesce("near", "far")
    return found.join(firsts, ["mint", "stretch"]).select("mint", "us", "horizon", "price", best["us"].alias("next_us"), best["price"].alias("next_price"))


def threshold_sweep(scored: DataFrame, percents: Sequence[int] = range(10, 91, 5)) -> DataFrame:
    """Confusion counts, precision, recall, F1 and signal rate of `score >= percent / 100` against y, for each percent.
    Rows are counted by the thresholds they reach; the sums run over that table of a row a threshold."""
    reached = sum((F.when(F.col("score") >= p / 100.0, 1).otherwise(0) for p in percents), F.lit(0))
    counts = scored.groupBy(reached.alias("reached")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(p).alias("percent")) for i, p in enumerate(percents)])
    each = counts.withColumn("t", F.explode(names))
    over = F.col("reached") >= F.col("t.i")
    n = {k: F.coalesce(F.sum(F.when(over if hit else ~over, F.col(c))), F.lit(0)) for k, hit, c in (("tp", True, "pos"), ("fp", True, "neg"), ("fn", False, "pos"), ("tn", False, "neg"))}
    out = each.groupBy(F.col("t.percent").alias("percent")).agg(*[v.alias(k) for k, v in n.items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("percent", "tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + fp, tp + fp + fn + tn).alias("signal_rate"))


def auc_by(scored: DataFrame, key: str) -> DataFrame:
    """Rank-sum AUC of score against y by key, ties at half; null where one class is missing. Rows are summed by score
    before any are ordered."""
    by_score = scored.groupBy(key, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(key).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by_score.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return won.groupBy(key).agg(pos.alias("positives"), neg.alias("negatives"), F.try_divide(F.sum("won"), pos * neg).alias("auc"))


def score_bins(scored: DataFrame, per_unit: int = 20) -> DataFrame:
    """Samples, share of positives and mean forward net volume by score bin."""
    return scored.groupBy(F.floor(F.col("score") * per_unit).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("positive_share"), F.avg(F.col("forward_buy") - F.col("forward_sell")).alias("mean_net"))


def confidence_bands(scored: DataFrame, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """Accuracy of `score >= 0.5` where the score is high, low or between."""
    band = F.when(F.col("score") >= high, "high").when(F.col("score") <= low, "low").otherwise("between")
    right = (F.col("score") >= 0.5).cast("int") == F.col("y")
    return scored.groupBy(band.alias("band")).agg(F.count("*").alias("n"), share(F.count_if(right), F.count("*")).alias("accuracy"))


def hours_since_start(scored: DataFrame) -> DataFrame:
    """Hours from a coin's first sample; the flag says if they are between 1 and 10. Firsts are summed, then joined: no coin is ordered."""
    first = scored.groupBy("coin_id").agg(F.min("sample_us").alias("first_us"))
    hours = (F.col("sample_us") - F.col("first_us")) / HOUR
    return scored.join(first, "coin_id").select("coin_id", "sample_us", hours.alias("hours"), hours.between(1, 10).alias("in_window"))


def buy_feasible(bars: DataFrame, size: float) -> DataFrame:
    """Whether the next bar has the volume, and trades below its open."""
    found = (F.col("volume") >= size) & (F.col("low") < F.col("open"))
    rows = in_pieces(bars.withColumn("__ok", found), "symbol", "us", lambda rows, w: rows.withColumn("can_buy", F.coalesce(F.lead("__ok").over(w), F.lit(False))), 0, 1)
    return rows.select("symbol", "us", "can_buy")


def first_liquid_exit(bars: DataFrame, coins: float, hold: int = 3, within: int = 10) -> DataFrame:
    """The start of the first of `within` bars after `hold` bars whose volume is `coins` at its open or more; null without one."""
    rows = bars.withColumn("__exit", F.when(F.col("volume") >= coins * F.col("open"), F.col("us")))
    rows = in_pieces(rows, "symbol", "us", lambda rows, w: rows.withColumn("exit_us", F.min("__exit").over(w.rowsBetween(hold + 1, hold + within))), 0, hold + within)
    return rows.select("symbol", "us", "exit_us")


def any_next(bars: DataFrame, condition: Column, rows: int) -> DataFrame:
    """Whether the condition holds in any of the next rows of the symbol."""
    hit = bars.withColumn("__hit", condition.cast("int"))
    found = in_pieces(hit, "symbol", "us", lambda df, w: df.withColumn("any_next", F.coalesce(F.max("__hit").over(w.rowsBetween(1, rows)), F.lit(0)) == 1), 0, rows)
    return found.select("symbol", "us", "any_next")


def daily_frame(bars: DataFrame, first_hours: int = 6) -> DataFrame:
    """Daily bars with the close and volume of the first hours, in one aggregation, and the gap to the day before's close."""
    early = F.col("us") % DAY < first_hours * HOUR
    days = bars.groupBy("symbol", F.floor(F.col("us") / DAY).alias("day")).agg(
        F.min_by("open", "us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "us").alias("close"), F.sum("volume").alias("volume"),
        F.max_by("close", F.when(early, F.col("us"))).alias("early_close"), F.sum(F.when(early, F.col("volume"))).alias("early_volume"),
    )
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    return days.withColumns({"intraday": F.try_divide(F.col("close"), F.col("open")) - 1, "gap": F.try_divide(F.col("open"), before) - 1})


def top_n_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order given, with their place; Spark cuts each task's rows to n a group before the exchange."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def overview(trades: DataFrame) -> DataFrame:
    """Counts of the whole table."""
    return trades.agg(F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.countDistinct("mint").alias("coins"), F.count_if("is_buy").alias("buys"), F.count_if("is_sell").alias("sells"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def launched_since(trades: DataFrame, since_us: int) -> DataFrame:
    """Coins whose first trade is at a time or after, with their trades, traders and successful trades."""
    out = trades.groupBy("mint").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.count_if("succeeded").alias("succeeded"))
    return out.where(F.col("first_us") >= since_us)


def token_rates(trades: DataFrame) -> DataFrame:
    """Trades and base volume by trader and hour of a coin."""
    out = trades.groupBy("mint").agg(F.count("*").alias("n"), F.countDistinct("swapper").alias("traders"), F.sum("sol_amount").alias("volume"), ((F.max("us") - F.min("us")) / HOUR).alias("hours"))
    return out.select("mint", "hours", share(F.col("n"), F.col("traders")).alias("trades_per_trader"), (F.col("n") / (F.col("hours") + 0.1)).alias("trades_per_hour"), F.try_divide("volume", "traders").alias("volume_per_trader"))
