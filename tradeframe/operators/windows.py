"""Features of look-back windows on a regular grid of sample times.

Trades are not joined with samples by range. Each trade is exploded to the few samples whose windows it is in, computed
from its time, and rows are then grouped by (coin, sample): cost is linear in trades, and a hot coin spreads over its
samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.columns import ratio

SECOND = 1_000_000


@dataclass(frozen=True)
class GridConfig:
    """Seconds: between samples; before the first; after the last; and the look-back windows by name."""

    step: int = 60
    buffer: int = 120
    forward: int = 300
    least_trades: int = 100
    windows: tuple[tuple[str, int], ...] = (("30s", 30), ("60s", 60), ("120s", 120))


#: Wide enough for the sparse test tables: durations times 120.
SPARSE = GridConfig(7200, 14_400, 36_000, 100, (("30s", 3600), ("60s", 7200), ("120s", 14_400)))


def coin_ranges(pairs: DataFrame, cfg: GridConfig) -> DataFrame:
    """Coins with trades enough and a span that holds both buffers; first sample and number of the last."""
    rows = pairs.groupBy("mint").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("total_transactions"))
    start, end = F.col("first_us") + cfg.buffer * SECOND, F.col("last_us") - cfg.forward * SECOND
    rows = rows.where((F.col("total_transactions") >= cfg.least_trades) & (start < end))
    return rows.withColumns({"anchor": start, "k_max": F.floor((end - start) / (cfg.step * SECOND))})


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many parts as the session's shuffles have. Without a number parts would be put together
    up to a compressed size, of which a task's hash table is many times; so a task's share falls with the parts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sampling_grid(ranges: DataFrame, cfg: GridConfig) -> DataFrame:
    rows = ranges.select("mint", "total_transactions", "anchor", F.explode(F.sequence(F.lit(0).cast("long"), "k_max")).alias("k"))
    return rows.withColumn("sample_us", F.col("anchor") + F.col("k") * (cfg.step * SECOND))


def window_parts(named: Sequence[tuple[str, int]]) -> tuple[dict[str, Column], dict[str, Column]]:
    """What is summed over a window's trades, and flags of which a trader's greatest counts, for rows with `back`, the
    microseconds from trade to sample."""
    amount, buy, sell = F.col("sol_amount"), F.col("is_buy"), F.col("is_sell")
    sums, flags = {}, {}
    for name, seconds in named:
        w = (F.col("back") > 0) & (F.col("back") <= seconds * SECOND)
        for part, side in (("all", F.lit(True)), ("buy", buy), ("sell", sell)):
            sums |= {f"{part}_volume_{name}": F.sum(F.when(w & side, amount).otherwise(0.0)), f"{part}_txns_{name}": F.count_if(w & side)}
            flags[f"{part}_seen_{name}"] = F.max((w & side).cast("int"))
        sums[f"squares_{name}"] = F.sum(F.when(w, amount * amount).otherwise(0.0))
        for kind, a, b in (("small", 0, 1), ("medium", 1, 10), ("big", 10, 100), ("whale", 100, None)):
            inside = (amount > 0 if kind == "small" else amount >= a) & (F.lit(True) if b is None else amount < b)
            sums[f"{kind}_{name}"] = F.count_if(w & inside)
    return sums, flags


def window_columns(named: Sequence[tuple[str, int]]) -> list[Column]:
    """The 23 features of each window, from the sums of window_parts()."""
    out = []
    for name, _ in named:
        v, b, s = (F.col(f"{x}_volume_{name}") for x in ("all", "buy", "sell"))
        n, nb, ns = (F.col(f"{x}_txns_{name}").cast("double") for x in ("all", "buy", "sell"))
        u, ub, us = (F.col(f"{x}_seen_{name}") for x in ("all", "buy", "sell"))
        mean = ratio(v, n)
        spread = F.sqrt(F.greatest(ratio(F.col(f"squares_{name}"), n) - mean * mean, F.lit(0.0)))
        columns = {
            "total_volume": v, "buy_volume": b, "sell_volume": s, "buy_ratio": ratio(b, v), "volume_imbalance": ratio(b - s, v),
            "total_txns": n.cast("long"), "buy_txns": nb.cast("long"), "sell_txns": ns.cast("long"), "txn_buy_ratio": ratio(nb, n), "txn_flow_imbalance": ratio(nb - ns, n),
            "unique_traders": u.cast("long"), "unique_buyers": ub.cast("long"), "unique_sellers": us.cast("long"), "trader_buy_ratio": ratio(ub.cast("double"), u.cast("double")),
            "avg_txn_size": mean, "volume_per_trader": ratio(v, u.cast("double")), "volume_concentration": ratio(spread, mean), "volume_mean": mean, "volume_std": spread,
            **{f"{kind}_txn_ratio": ratio(F.col(f"{kind}_{name}").cast("double"), n) for kind in ("small", "medium", "big", "whale")},
        }
        out += [c.alias(f"{k}_{name}") for k, c in columns.items()]
    return out


def window_features(pairs: DataFrame, cfg: GridConfig) -> DataFrame:
    """(mint, sample_us, total_transactions), for each window volumes, counts, distinct traders and ratios, and what is
    bought and sold in the forward window; samples without trades have zeros."""
    ranges = coin_ranges(pairs, cfg)
    step, widest = cfg.step * SECOND, max(s for _, s in cfg.windows) * SECOND
    low = F.greatest(F.floor((F.col("us") - cfg.forward * SECOND - F.col("anchor")) / step) + 1, F.lit(0))
    high = F.least(F.floor((F.col("us") + widest - F.col("anchor")) / step), F.col("k_max"))
    rows = pairs.join(ranges.select("mint", "anchor", "k_max"), "mint").withColumns({"low": low, "high": high}).where("low <= high")
    rows = rows.select("mint", "us", "swapper", "is_buy", "is_sell", "sol_amount", "anchor", F.explode(F.sequence("low", "high")).alias("k"))
    back = F.col("anchor") + F.col("k") * step - F.col("us")
    rows = rows.withColumn("back", back)

    amount, buy, sell = F.col("sol_amount"), F.col("is_buy"), F.col("is_sell")
    ahead = F.col("back") <= 0
    sums = {"forward_buy": F.sum(F.when(ahead & buy, amount).otherwise(0.0)), "forward_sell": F.sum(F.when(ahead & sell, amount).otherwise(0.0))}
    more, flags = window_parts(cfg.windows)
    sums |= more
    # sums shrink to a row a sample in each task; traders don't, so those of the windows are dealt first and then have a row of
    # flags each. Both are left joins by a whole key: who asks for neither traders nor sums has no step for them
    whole = rows.groupBy("mint", "k").agg(*[c.alias(n) for n, c in sums.items()])
    seen = in_parts(rows.where("back > 0").select("mint", "k", "swapper", "is_buy", "is_sell", "back"), "mint", "k", "swapper")
    by_trader = seen.groupBy("mint", "k", "swapper").agg(*[c.alias(n) for n, c in flags.items()])
    grouped = whole.join(by_trader.groupBy("mint", "k").agg(*[F.sum(n).alias(n) for n in flags]), ["mint", "k"], "left")
    full = sampling_grid(ranges, cfg).join(grouped, ["mint", "k"], "left").fillna(0)
    return full.select(F.col("mint").alias("coin_id"), "sample_us", "total_transactions", *window_columns(cfg.windows), F.col("forward_buy").alias("forward_buy_volume_300s"), F.col("forward_sell").alias("forward_sell_volume_300s"), (F.col("forward_buy") > F.col("forward_sell")).cast("int").alias("is_profitable_300s"))
