"""Bar studies, entry signals, price-impact events and tests between groups, as set-based operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tradeframe.functions.columns import size_category
from tradeframe.operators import places
from tradeframe.operators.bars import change, rolling, with_returns
from tradeframe.operators.joins import event_window_stats
from tradeframe.operators.reversal import p_values
from tradeframe.operators.studies import DAY, HOUR, SECOND, daily_frame, share


def with_shape(bars: DataFrame) -> DataFrame:
    """Add hl_spread, hl_spread_pct (of the close) and midpoint."""
    spread = F.col("high") - F.col("low")
    return bars.withColumns({"hl_spread": spread, "hl_spread_pct": F.try_divide(spread, F.col("close")) * 100, "midpoint": (F.col("high") + F.col("low")) / 2})


def bar_shape(bars: DataFrame) -> DataFrame:
    return with_shape(bars).select("symbol", "us", "hl_spread", "hl_spread_pct", "midpoint")


def calendar(bars: DataFrame, opens: int = 570, closes: int = 960) -> DataFrame:
    """Hour, minute of the day, weekday (1 is Sunday), quarter and session by the minutes at which trading opens and closes."""
    minute = F.floor(F.col("us") / (60 * SECOND)) % 1440
    at = F.timestamp_micros("us")
    session = F.when((minute >= opens) & (minute < closes), "regular").otherwise("extended")
    return bars.select("symbol", "us", F.floor(minute / 60).alias("hour"), minute.alias("minute"), F.dayofweek(at).alias("weekday"), F.quarter(at).alias("quarter"), session.alias("session"))


def spread_bounce(bars: DataFrame, within: int = 3) -> DataFrame:
    """Spreads by symbol, and how many of the wide ones (over the upper quartile) have a narrow one (under the lower) in
    the next `within` bars. Only bars with so many behind them can be followed."""
    shaped = with_shape(bars)
    cuts = places.quantiles(shaped, ["symbol"], "hl_spread_pct", {"low_cut": 0.25, "high_cut": 0.75})
    look = lambda rows, w: rows.withColumns({"least": F.min("hl_spread_pct").over(w.rowsBetween(1, within)), "behind": F.count("*").over(w.rowsBetween(1, within))})
    rows = places.in_pieces(shaped, "symbol", "us", look, 0, within).join(cuts, "symbol")
    wide = F.col("hl_spread_pct") > F.col("high_cut")
    bounced = F.count_if(wide & (F.col("behind") == within) & (F.col("least") < F.col("low_cut")))
    return rows.groupBy("symbol").agg(
        F.avg("hl_spread").alias("mean"), F.percentile("hl_spread", 0.5).alias("median"), F.stddev_samp("hl_spread").alias("std"), F.avg("hl_spread_pct").alias("mean_pct"),
        places.pair_corr("hl_spread_pct", "volume").alias("volume_corr"), F.count_if(wide).alias("wide"), bounced.alias("bounced"), share(bounced, F.count_if(wide)).alias("bounce_rate"),
    )


def volatility_clustering(bars: DataFrame, lags: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Autocorrelation of absolute and squared returns at each lag, and how the rolling deviation of returns goes with the spread."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("r", change(F.lag("close").over(w)))
        return rows.withColumns({f"vol_{n}": rolling(F.stddev_samp("r"), "r", n, n, w) for n in (5, 20)} | {f"r_{k}": F.lag("r", k).over(w) for k in lags})

    rows = places.in_pieces(with_shape(bars), "symbol", "us", work, max(20, *lags) + 1)
    abs_corr = [places.pair_corr(F.abs("r"), F.abs(f"r_{k}")).alias(f"abs_autocorr_{k}") for k in lags]
    square_corr = [places.pair_corr(F.col("r") * F.col("r"), F.col(f"r_{k}") * F.col(f"r_{k}")).alias(f"square_autocorr_{k}") for k in lags]
    return rows.groupBy("symbol").agg(*abs_corr, *square_corr, *[places.pair_corr(f"vol_{n}", "hl_spread_pct").alias(f"vol_{n}_spread_corr") for n in (5, 20)])


def price_impact(bars: DataFrame) -> DataFrame:
    """Correlation of volume with the absolute return, with the next one, and with the next spread."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("size", F.abs(change(F.lag("close").over(w))))
        return rows.withColumns({"next_size": F.lead("size").over(w), "next_spread": F.lead("hl_spread_pct").over(w)})

    rows = places.in_pieces(with_shape(bars), "symbol", "us", work, 1, 1)
    return rows.groupBy("symbol").agg(places.pair_corr("volume", "size").alias("return_corr"), places.pair_corr("volume", "next_size").alias("next_return_corr"), places.pair_corr("volume", "next_spread").alias("next_spread_corr"))


def volume_quartiles(bars: DataFrame) -> DataFrame:
    """Mean absolute return and spread by quartile of the symbol's volume; a volume at a cut is in the lower quartile."""
    rows = with_returns(with_shape(bars))
    cuts = rows.groupBy("symbol").agg(F.percentile("volume", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    quartile = F.size(F.filter("cuts", lambda c: c < F.col("volume"))) + 1
    return rows.join(cuts, "symbol").groupBy("symbol", quartile.alias("quartile")).agg(F.count("*").alias("n"), F.avg(F.abs("r")).alias("mean_abs_return"), F.avg("hl_spread_pct").alias("mean_spread_pct"))


def daily_strategies(bars: DataFrame, gap: float = 0.01) -> DataFrame:
    """Returns of daily rules: open to close, close to the next open, from the first hours' end where they fell, with the
    gap where it is wide, open to close where the first hours' volume is over its mean of 20 days, and from the first
    hours' end where their close leaves the band of the day before."""
    day = Window.partitionBy("symbol").orderBy("day")
    days = daily_frame(bars).withColumns({
        "next_open": F.lead("open").over(day), "before": F.lag("close").over(day), "mean_volume": F.avg("early_volume").over(day.rowsBetween(-19, 0)),
    })
    days = days.withColumn("held", F.try_divide(F.col("close"), F.col("before")) - 1)
    past = day.rowsBetween(-19, 0)
    days = days.withColumn("vol", F.when(F.count("held").over(past) >= 10, F.stddev_samp("held").over(past)))
    rest = F.try_divide(F.col("close"), F.col("early_close")) - 1
    out = (F.col("early_close") > F.col("before") * (1 + F.col("vol"))) | (F.col("early_close") < F.col("before") * (1 - F.col("vol")))
    sign = F.when(F.col("gap") > gap, 1).when(F.col("gap") < -gap, -1).otherwise(0)
    return days.select(
        "symbol", "day", F.col("intraday").alias("open_close"), (F.try_divide(F.col("next_open"), F.col("close")) - 1).alias("close_open"),
        F.when(F.col("early_close") < F.col("open"), rest).otherwise(0.0).alias("reversal"), (sign * F.col("intraday")).alias("gap_and_go"),
        F.when(F.col("early_volume") > F.col("mean_volume"), F.col("intraday")).otherwise(0.0).alias("volume_filter"), F.when(out, rest).otherwise(0.0).alias("breakout"),
    )


def time_scales(bars: DataFrame, hours: Sequence[int] = (1, 2, 4, 8, 24)) -> DataFrame:
    """Autocorrelation at lag 1, and mean over deviation, of volume summed at several granularities."""
    wide = bars.withColumn("hours", F.explode(F.array(*[F.lit(h) for h in hours])))
    sums = wide.groupBy("symbol", "hours", F.floor(F.col("us") / (F.col("hours") * HOUR)).alias("slot")).agg(F.sum("volume").alias("volume"))
    rows = sums.withColumn("before", F.lag("volume").over(Window.partitionBy("symbol", "hours").orderBy("slot")))
    return rows.groupBy("symbol", "hours").agg(F.count("*").alias("slots"), places.pair_corr("volume", "before").alias("autocorr"), F.try_divide(F.avg("volume"), F.stddev_samp("volume")).alias("signal_noise"))


def describe(bars: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles, tails and greatest of a column by symbol, and how many lie 1.5 quartile ranges outside."""
    points = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    stats = bars.groupBy("symbol").agg(F.percentile(column, F.array(*[F.lit(p) for p in points])).alias("q"))
    fence = (F.col("q")[4] - F.col("q")[2]) * 1.5
    x = F.col(column)
    outside = (x < F.col("q")[2] - fence) | (x > F.col("q")[4] + fence)
    named = [F.first(F.col("q")[i]).alias(f"p{round(p * 100):02}") for i, p in enumerate(points)]
    return bars.join(stats, "symbol").groupBy("symbol").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("greatest"), *named, F.count_if(outside).alias("outliers"))


def filled_grid(bars: DataFrame, step_us: int = HOUR) -> DataFrame:
    """A row for each step from a symbol's first bar to its last; a step without a bar has the last close and no volume.
    Each bar is exploded up to the next one: there is no join with a grid."""
    ahead = places.in_pieces(bars, "symbol", "us", lambda rows, w: rows.withColumn("upto", F.coalesce(F.lead("us").over(w) - step_us, F.col("us"))), 0, 1)
    steps = ahead.withColumn("step", F.explode(F.sequence("us", "upto", F.lit(step_us))))
    real = F.col("step") == F.col("us")
    price = lambda c: F.when(real, F.col(c)).otherwise(F.col("close")).alias(c)
    return steps.select("symbol", F.col("step").alias("us"), *[price(c) for c in ("open", "high", "low")], "close", F.when(real, F.col("volume")).otherwise(0.0).alias("volume"))


def trader_size_class(trades: DataFrame) -> DataFrame:
    """Each trader's class by the largest base amount."""
    most = trades.groupBy("swapper").agg(F.max("sol_amount").alias("largest"))
    return most.select("swapper", "largest", size_category(F.col("largest")).alias("size_class"))


def pair_breakdown(trades: DataFrame, base: str) -> DataFrame:
    """Trades of each coin by what its legs are: the coin, the base asset or another token."""
    kind = lambda leg: F.when(F.col(leg) == F.col("mint"), "coin").when(F.col(leg) == base, "base").otherwise("other")
    other = F.when(F.col("swap_from_mint") == F.col("mint"), F.col("swap_to_mint")).otherwise(F.col("swap_from_mint"))
    return trades.groupBy("mint", kind("swap_from_mint").alias("from_kind"), kind("swap_to_mint").alias("to_kind"), other.alias("counter")).agg(F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.sum("sol_amount").alias("base_volume"))


def first_day(trades: DataFrame) -> DataFrame:
    """Traders and base volume of each token on the calendar day of its first trade; a trade counts for both its legs."""
    legs = trades.select(F.explode(F.array_distinct(F.array("swap_from_mint", "swap_to_mint"))).alias("token"), F.floor(F.col("us") / DAY).alias("day"), "swapper", "sol_amount")
    days = legs.groupBy("token", "day").agg(F.count("*").alias("trades"), F.countDistinct("swapper").alias("traders"), F.sum("sol_amount").alias("base_volume"))
    return days.groupBy("token").agg(F.min_by(F.struct("day", "trades", "traders", "base_volume"), "day").alias("d")).select("token", "d.*")


def trader_sequences(trades: DataFrame, block_ms: int, least: int = 3) -> DataFrame:
    """Who trades after whom in blocks of `least` trades or more: traders, neighbours by one trader, whether two traders
    alternate, and the sequence of first, same and new traders with their sides."""
    at = F.struct("us", "row_index", "swapper", F.when(F.col("is_buy"), "B").otherwise("S").alias("side"))
    blocks = trades.groupBy("mint", F.floor(F.col("us") / (block_ms * 1000)).alias("block")).agg(F.array_sort(F.collect_list(at)).alias("t"), F.countDistinct("swapper").alias("traders")).where(F.size("t") >= least)
    n = F.size("t")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(F.col("t")[i]["swapper"] == F.col("t")[i - 1]["swapper"], F.concat(F.lit("Same"), F.col("t")[i]["side"])).otherwise(F.concat(F.lit("New"), F.col("t")[i]["side"])))
    rows = blocks.withColumn("steps", steps).withColumn("same", F.size(F.filter("steps", lambda s: s.startswith("Same"))))
    return rows.select(
        "mint", "block", n.alias("trades"), "traders", "same", ((F.col("traders") == 2) & (n - 1 - F.col("same") >= n - 2)).alias("alternating"),
        F.concat(F.lit("T1"), F.col("t")[0]["side"], F.array_join("steps", "")).alias("sequence"),
    )


def with_previous(trades: DataFrame, column: str, name: str, bucket_us: int = DAY) -> DataFrame:
    """Add the value of the coin's trade before. Trades are dealt by coin and stretch of time, so that no coin is one
    task; a stretch's first trade takes the last value of the stretch before from a table of a row a stretch."""
    rows = trades.withColumn("__stretch", F.floor(F.col("us") / bucket_us))
    near = F.lag(column).over(Window.partitionBy("mint", "__stretch").orderBy("us", "row_index"))
    first = F.row_number().over(Window.partitionBy("mint", "__stretch").orderBy("us", "row_index")) == 1
    lasts = rows.groupBy("mint", "__stretch").agg(F.max_by(column, F.struct("us", "row_index")).alias("__last"))
    lasts = lasts.select("mint", "__stretch", F.lag("__last").over(Window.partitionBy("mint").orderBy("__stretch")).alias("__far"))
    out = rows.withColumns({"__near": near, "__first": first}).join(lasts, ["mint", "__stretch"])
    return out.withColumn(name, F.when(F.col("__first"), F.col("__far")).otherwise(F.col("__near"))).drop("__near", "__first", "__far", "__stretch")


def impact_events(priced: DataFrame, thresholds: Sequence[float], seconds: Sequence[int]) -> DataFrame:
    """For each trade whose price differs from the one before by a threshold or more, and each window after it, its own
    time included: the relative move to the window's last price, the move back, the best move back, trades and volume.

    Windows are read off sums that run over stretches of their width, so that a hot stretch costs no more than its rows."""
    moved = with_previous(priced, "price", "before").withColumn("change", F.try_divide(F.col("price") - F.col("before"), F.col("before")))
    events = moved.where(F.abs("change") >= min(thresholds)).select("mint", "us", F.col("row_index").alias("event"), F.col("price").alias("event_price"), "change")
    sums = event_window_stats(events, priced, "price", seconds, closed=True, amount="sol_amount")
    sums = sums.withColumnsRenamed({"greatest": "top", "least": "bottom", "n": "trades", "total": "volume"}).withColumn("window_s", F.col("window_s").cast("int"))
    up, p = F.col("change") > 0, F.col("event_price")
    move = (F.col("last") - p) / p
    best = F.when(up, (p - F.col("bottom")) / p).otherwise((F.col("top") - p) / p)
    hit = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.abs("change"))
    return sums.select("mint", "event", F.explode(hit).alias("threshold"), "window_s", "change", move.alias("reversion"), F.when(up, -move).otherwise(move).alias("strength"), best.alias("best_move"), "trades", "volume")


def impact_summary(events: DataFrame) -> DataFrame:
    """Events, mean move back, and share that moved back, by threshold and window."""
    return events.groupBy("threshold", "window_s").agg(F.count("*").alias("events"), F.avg("strength").alias("mean_strength"), F.avg("best_move").alias("mean_best"), share(F.count_if(F.col("strength") > 0), F.count("*")).alias("win_rate"))


def two_sample_t(df: DataFrame, by: str, flag: str, value: str) -> DataFrame:
    """Student's t with pooled variance of a value where the flag holds against where it doesn't, by key, from one pass of sums."""
    yes, no = (F.when(c, F.col(value)) for c in (F.col(flag), ~F.col(flag)))
    n, m = F.count(yes), F.count(no)
    pooled = ((n - 1) * F.var_samp(yes) + (m - 1) * F.var_samp(no)) / (n + m - 2)
    t = F.try_divide(F.avg(yes) - F.avg(no), F.sqrt(pooled * (1 / n + 1 / m)))
    return df.groupBy(by).agg(n.alias("n_yes"), m.alias("n_no"), F.avg(yes).alias("mean_yes"), F.avg(no).alias("mean_no"), F.when((n > 1) & (m > 1), t).alias("t"))


def chi_square(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """Counts of each pair of values that occurs, with the counts expected of independent ones, and the statistic of the
    whole table: N * (sum of n * n / (row sum * column sum) - 1), for which empty cells are not needed. Rows where either is null are left out."""
    cells = df.groupBy(row.alias("row"), column.alias("column")).agg(F.count("*").alias("n")).where("row is not null and column is not null")
    whole = Window.partitionBy()
    sums = cells.withColumns({"row_n": F.sum("n").over(Window.partitionBy("row")), "column_n": F.sum("n").over(Window.partitionBy("column")), "all_n": F.sum("n").over(whole)})
    margins = F.col("row_n").cast("double") * F.col("column_n")
    return sums.select("row", "column", "n", (margins / F.col("all_n")).alias("expected"), (F.col("all_n") * (F.sum(F.col("n") * F.col("n") / margins).over(whole) - 1)).alias("chi_square"))


def pick_threshold(sweep: DataFrame, precision: float = 0.65, rates: tuple[float, float] = (0.05, 0.15)) -> DataFrame:
    """The thresholds of greatest F1, of greatest recall at a precision or more, and of greatest precision at a signal rate between two; the lower of equals."""
    best = lambda by, ok: F.max_by("percent", F.when(ok & F.col(by).isNotNull(), F.struct(F.col(by), -F.col("percent"))))
    every = F.lit(True)
    return sweep.agg(best("f1", every).alias("by_f1"), best("recall", F.col("precision") >= precision).alias("by_recall"), best("precision", F.col("signal_rate").between(*rates)).alias("by_precision"))


def every_nth(df: DataFrame, by: str, order: str, step: int) -> DataFrame:
    """Each step-th row of a group in its order, from the first."""
    return places.ranked(df, [by], [order], "__place").where(F.col("__place") % step == 0).drop("__place")


def corr_screen(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Pearson's correlation of each feature with each target, in one pass, with t = r * sqrt((n - 2) / (1 - r * r))."""
    stats = [F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), places.pair_corr(f, t).alias("r"), F.count_if(F.col(f).isNotNull() & F.col(t).isNotNull()).alias("n")) for f in features for t in targets]
    rows = df.agg(F.array(*stats).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    return rows.withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r"))))


def rank_screen(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(feature, target, n, pearson, spearman, t, mean_size, p, significant) of each pair, over rows that have both values.

    Spearman's is the correlation of mean ranks. Rows are counted by pair and values; ranks come from the counted values of
    each pair, dealt by ranges, and are taken about their mean, (n + 1) / 2. t and p are Pearson's, two-sided; significant is
    p under 0.05. Correlations are null where either value doesn't vary."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets))
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null")
    key = ["feature", "target"]
    plain = rows.groupBy(*key).agg(F.count("*").alias("n"), places.pair_corr(F.col("x"), F.col("y")).alias("pearson"))
    joint = rows.groupBy(*key, "x", "y").agg(F.count("*").alias("m"))
    for c in ("x", "y"):
        joint = joint.join(places.mean_ranks(rows.select(*key, c), key, c, f"r{c}").select(*key, c, (F.col(f"r{c}") - (F.col("all") + 1) / 2).alias(f"r{c}")), [*key, c])
    product = lambda a, b: F.sum(F.col("m") * F.col(a) * F.col(b))
    ranks = joint.groupBy(*key).agg(F.try_divide(product("rx", "ry"), F.sqrt(product("rx", "rx") * product("ry", "ry"))).alias("spearman"))
    out = plain.join(ranks, key, "left")
    out = out.withColumn("t", F.try_divide(F.col("pearson") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("pearson") * F.col("pearson"))))
    out = out.withColumn("mean_size", (F.abs("pearson") + F.abs("spearman")) / 2)
    return p_values(out, "r", F.col("pearson"), F.col("n") - 2).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def screen_summary(screen: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(group, target, features, mean_size, max_size, significant) of a screen's features whose names hold one of a group's
    words; a feature may be in several groups, or in none."""
    named = F.array(*(F.when(F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("feature"), w)), F.lit(name)) for name, words in groups.items()))
    rows = screen.where("pearson is not null and spearman is not null").withColumn("group", F.explode(F.array_compact(named)))
    return rows.groupBy("group", "target").agg(F.count("*").alias("features"), F.avg("mean_size").alias("mean_size"), F.max("mean_size").alias("max_size"), F.count_if("significant").alias("significant"))
