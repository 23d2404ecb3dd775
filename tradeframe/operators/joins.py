"""What lies in a window after each event, trades of tokens' first days, kinds of trades, and the range of a time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND, DAY = 1_000_000, 86_400_000_000


def event_window_stats(events: DataFrame, observed: DataFrame, value: str, seconds: Sequence[int], by: str = "mint", at: str = "us", closed: bool = False, amount: str | None = None) -> DataFrame:
    """A row for each event and window: the events' columns with window_s, n, total (of `amount`, else of `value`), least,
    greatest and last (by time and row_index) of `value` over the observations of the event's group in (t, t + window_s],
    or [t, t + window_s] if `closed`. Windows without observations have n 0 and nulls. Events are told apart by all of
    their columns.

    A window lies in two stretches of its own width: it is the end of one, from the event on, and the beginning of the next.
    Both are read off sums that run over a stretch, backwards and forwards, so the work is that of sorting events and
    observations, whatever a stretch holds."""
    size, names = F.col("__window") * SECOND, ("n", "total", "least", "greatest", "last")
    windows = F.explode(F.array(*(F.lit(s).cast("long") for s in seconds)))
    asked = events.withColumn("__window", windows)
    slot, time = F.floor(F.col(at) / size), F.col(at)
    # an observation has twice its time as key; one more puts an event after those of its own time
    ends = F.array(F.struct(slot.alias("slot"), (time * 2 + (0 if closed else 1)).alias("key"), F.lit(True).alias("tail")), F.struct((slot + 1).alias("slot"), ((time + size) * 2).alias("key"), F.lit(False).alias("tail")))
    asked = asked.select(F.struct(*events.columns).alias("__event"), F.col(by).alias("__by"), "__window", F.explode(ends).alias("__x")).select("__event", "__by", "__window", "__x.*", F.lit(False).alias("__seen"))
    offered = observed.where(F.col(by).isNotNull() & F.col(at).isNotNull()).withColumn("__window", windows)
    offered = offered.select(
        F.col(by).alias("__by"), "__window", F.floor(time / size).alias("slot"), (time * 2).alias("key"), F.lit(True).alias("__seen"),
        F.col(value).cast("double").alias("__value"), F.col(amount or value).cast("double").alias("__amount"), F.struct(time.alias("us"), F.col("row_index"), F.col(value).cast("double").alias("value")).alias("__last"),
    )
    both = offered.unionByName(asked, allowMissingColumns=True)
    stretch = Window.partitionBy("__by", "__window", "slot")
    sums = {"n": F.count_if("__seen"), "total": F.sum("__amount"), "least": F.min("__value"), "greatest": F.max("__value"), "last": F.max("__last")}
    upto, onward = (stretch.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in ("key", F.col("key").desc()))
    found = both.select("__event", "__window", "__seen", "tail", *(c.over(w).alias(f"{n}_{k}") for k, w in (("upto", upto), ("onward", onward)) for n, c in sums.items())).where("not __seen")
    found = found.select("__event", "__window", *(F.when(F.col("tail"), F.col(f"{n}_onward")).otherwise(F.col(f"{n}_upto")).alias(f"__{n}") for n in names))
    stats = found.groupBy("__event", F.col("__window").alias("window_s")).agg(F.sum("__n").alias("n"), F.sum("__total").alias("total"), F.min("__least").alias("least"), F.max("__greatest").alias("greatest"), F.max("__last").alias("__last"))
    return stats.select("__event.*", "window_s", "n", "total", "least", "greatest", F.col("__last.value").alias("last"))


def first_day_trades(trades: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The trades of each token's first calendar day, with the token and its day: a trade is of both its legs, once if they are
    one. `tokens` (token) keeps those alone. Days come from a table of a row a token."""
    legs = trades.withColumn("token", F.explode(F.array_distinct(F.array("swap_from_mint", "swap_to_mint")))).where("token is not null")
    legs = legs.join(tokens.select("token").distinct(), "token", "left_semi") if tokens is not None else legs
    first = legs.groupBy("token").agg(F.floor(F.min("us") / DAY).alias("day"))
    return legs.join(first, "token").where(F.floor(F.col("us") / DAY) == F.col("day"))


def trade_type(base: str = "SOL") -> Column:
    """What a swap is by its legs; null where a leg is."""
    src, dst = F.col("swap_from_mint") == base, F.col("swap_to_mint") == base
    return F.when(src, "base_to_token").when(dst, "token_to_base").when(~src & ~dst, "token_to_token")


def time_range(df: DataFrame, column: str) -> DataFrame:
    """(least, greatest, rows, nulls, days): the range of a time column in microseconds, and the days between its ends."""
    us = F.unix_micros(F.col(column).cast("timestamp"))
    return df.agg(F.min(us).alias("least"), F.max(us).alias("greatest"), F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"), ((F.max(us) - F.min(us)) / float(DAY)).alias("days"))
