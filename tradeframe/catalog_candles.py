"""Queries of candles at sample times and of token rates, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.operators import candles, joins, profiles, studies, windows
from tradeframe.operators.signals import pick_threshold

WIDTH = 7200
BANDS = ((0.2, 0.3), (0.4, 0.45))


def register(add, r, by_norm, scored, priced, pairs, scored_sql, trades_sql, table_sql) -> None:
    def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.sampling_grid(windows.coin_ranges(pairs(spark, sf_dir), windows.SPARSE), windows.SPARSE)

    cfg = windows.SPARSE
    GRID = trades_sql + f""", spans AS (SELECT mint, min(us) + {cfg.buffer * windows.SECOND} AS anchor, max(us) - {cfg.forward * windows.SECOND} AS last FROM pairs GROUP BY mint HAVING count(*) >= {cfg.least_trades})
, grid AS (SELECT mint, anchor + {cfg.step * windows.SECOND} * unnest(range(0, (last - anchor) // {cfg.step * windows.SECOND} + 1)) AS sample_us FROM spans WHERE anchor < last)
"""
    CANDLES = f""", made AS (SELECT g.mint, sample_us, arg_min(price, (us, row_index)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, row_index)) AS close, sum(sol_amount) AS volume, count(*) AS n FROM grid g JOIN priced_pairs p ON p.mint = g.mint AND us <= sample_us AND us > sample_us - {WIDTH * windows.SECOND} GROUP BY ALL)
, carried AS (SELECT g.mint, g.sample_us, open, high, low, close, volume, n, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY g.mint ORDER BY g.sample_us), 0e0) AS c FROM grid g LEFT JOIN made m ON m.mint = g.mint AND m.sample_us = g.sample_us)
"""
    columns = ", ".join(r(f"coalesce({c}, c) * 1e3", c) for c in ("open", "high", "low", "close")) + f", {r('coalesce(volume, 0e0)', 'volume')}, coalesce(n, 0) AS transactions"
    add("grid_candles", lambda spark, d: candles.grid_candles(priced(spark, d), grid(spark, d), WIDTH, 1e3), GRID + CANDLES + f"SELECT mint, sample_us, {columns} FROM carried")

    def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scored(spark, sf_dir).withColumn("regime", (F.col("sample_us") / (cfg.step * windows.SECOND)).cast("long") % 3)
        return candles.trade_signals(rows, 0.65, 1, BANDS, (24.0, 240.0))

    inside = " OR ".join(f"score BETWEEN {a} AND {b}" for a, b in BANDS)
    SIGNALS = f"""s0 AS (SELECT *, sample_us // {cfg.step * windows.SECOND} % 3 AS regime, (sample_us - min(sample_us) OVER (PARTITION BY coin_id)) / 3.6e9 AS hours FROM scored)
, sig AS (SELECT coin_id, sample_us, regime, score, CAST(coalesce(score >= 0.65, false) AS INTEGER) AS safe_long_signal, CAST(coalesce(regime = 1 AND ({inside}), false) AS INTEGER) AS contrarian_signal, CASE WHEN regime = 1 AND ({inside}) THEN 'contrarian' WHEN score >= 0.65 THEN 'safe_long' ELSE 'none' END AS signal_type, hours, CAST(hours BETWEEN 24 AND 240 AS INTEGER) AS valid_trading_window FROM s0)
"""
    kept = ("coin_id", "sample_us", "regime", "score", "safe_long_signal", "contrarian_signal", "signal_type", "hours_since_start", "valid_trading_window")
    add("trade_signals", lambda spark, d: signals(spark, d).select(*kept), scored_sql + ", " + SIGNALS + f"SELECT * EXCLUDE (hours, score), {r('score', 'score')}, {r('hours', 'hours_since_start')} FROM sig")
    add("signal_candles", lambda spark, d: candles.signal_candles(priced(spark, d), signals(spark, d), WIDTH, 1e3).select("coin_id", "sample_us", "close", "volume", "signal_type", "valid_trading_window"),
        GRID + CANDLES + ", scored AS (" + scored_sql.removeprefix("WITH scored AS (").rstrip() + ", " + SIGNALS + f"SELECT coin_id, sig.sample_us, {r('coalesce(close, c) * 1e3', 'close')}, {r('coalesce(volume, 0e0)', 'volume')}, signal_type, valid_trading_window FROM sig JOIN carried ON carried.mint = coin_id AND carried.sample_us = sig.sample_us")
    rates = lambda n: candles.token_rates(profiles.token_volume_table(n), "E", 2)
    RATES = f""", v AS ({table_sql}), t AS (SELECT *, (last_us - first_us) / 3.6e9 AS hours, total_trades / nullif(unique_traders, 0) AS tpt, total_sol_volume / nullif(unique_traders, 0) AS spt, non_sol_pair_trades / nullif(sol_pair_trades + non_sol_pair_trades, 0) AS non_sol_ratio, unique_pairs >= 2 AS is_diverse, lower(mint) LIKE '%e' AS is_launchpad FROM v)
"""
    by_norm("token_rates_full", lambda n: rates(n).select("mint", "trading_hours", "trades_per_trader", "trades_per_hour", "sol_per_trader", "non_sol_ratio", "is_diverse", "is_launchpad"), RATES + f"""SELECT mint, {r("hours", "trading_hours")}, {r("tpt", "trades_per_trader")}, {r("total_trades / (hours + 0.1e0)", "trades_per_hour")}, {r("spt", "sol_per_trader")}, {r("non_sol_ratio", "non_sol_ratio")}, is_diverse, is_launchpad FROM t""")
    by_norm("launchpad_split", lambda n: candles.launchpad_split(rates(n)), RATES + f"""SELECT is_launchpad, count(*) AS tokens, {r("sum(total_sol_volume)", "total_volume")}, {r("avg(total_sol_volume)", "mean_volume")}, {r("avg(total_trades)", "mean_trades")}, {r("avg(non_sol_ratio)", "mean_non_sol_ratio")}, count(*) FILTER (non_sol_ratio > 0.1) AS over_0_1,
  count(*) FILTER (non_sol_ratio > 0.5) AS over_0_5, count(*) FILTER (is_diverse) AS diverse, {r("quantile_cont(total_sol_volume, 0.5)", "median_volume")}, {r("count(*) * 1e0 / sum(count(*)) OVER ()", "token_share")} FROM t GROUP BY is_launchpad""")  # fmt: skip
    seconds = (3600, 43_200)

    def after_whales(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
        rows = priced(spark, sf_dir)
        return joins.event_window_stats(rows.where("sol_amount >= 95").select("mint", "us", F.col("row_index").alias("event")), rows, "sol_amount", seconds, closed=closed)

    for name, closed in (("event_window_stats", False), ("event_window_stats_closed", True)):
        add(name, lambda spark, d, closed=closed: after_whales(spark, d, closed), trades_sql + f""", e AS (SELECT mint, us, row_index AS event, w AS window_s FROM priced_pairs, (SELECT unnest({list(seconds)}) AS w) WHERE sol_amount >= 95)
SELECT e.mint, e.us, event, CAST(window_s AS BIGINT) AS window_s, count(p.us) AS n, {r("sum(sol_amount)", "total")}, {r("min(sol_amount)", "least")}, {r("max(sol_amount)", "greatest")}, {r("arg_max(sol_amount, (p.us, p.row_index))", "last")}
FROM e LEFT JOIN priced_pairs p ON p.mint = e.mint AND p.us {">=" if closed else ">"} e.us AND p.us <= e.us + window_s * 1000000::BIGINT GROUP BY ALL""")  # fmt: skip
    LEGS = ", legs AS (SELECT row_index, us, swapper, swap_from_mint AS token FROM norm UNION SELECT row_index, us, swapper, swap_to_mint FROM norm)"
    by_norm("first_day_trades", lambda n: joins.first_day_trades(n).select("token", "day", "row_index", "us", "swapper"), LEGS + " SELECT token, us // 86400000000 AS day, row_index, us, swapper FROM legs QUALIFY us // 86400000000 = min(us) OVER (PARTITION BY token) // 86400000000")
    by_norm("trade_types", lambda n: n.groupBy(joins.trade_type().alias("trade_type"), "mint").agg(F.count("*").alias("trades")), "SELECT CASE WHEN swap_from_mint = 'SOL' THEN 'base_to_token' WHEN swap_to_mint = 'SOL' THEN 'token_to_base' ELSE 'token_to_token' END AS trade_type, mint, count(*) AS trades FROM norm GROUP BY ALL")
    by_norm("time_range", lambda n: joins.time_range(n, "block_timestamp"), f"SELECT min(us) AS least, max(us) AS greatest, count(*) AS rows, 0::BIGINT AS nulls, {r('(max(us) - min(us)) / 86400000000e0', 'days')} FROM norm")
    picked = lambda s: pick_threshold(studies.threshold_sweep(s), 0.5, (0.05, 0.6))
    SWEPT = """, c AS (SELECT CAST(p AS INTEGER) AS percent, count(*) FILTER (score >= p / 100.0 AND y = 1) AS tp, count(*) FILTER (score >= p / 100.0 AND y = 0) AS fp, count(*) FILTER (score < p / 100.0 AND y = 1) AS fn, count(*) AS n FROM scored, range(10, 91, 5) t(p) GROUP BY p)
, m AS (SELECT percent, tp * 1e0 / nullif(tp + fp, 0) AS precision, tp * 1e0 / nullif(tp + fn, 0) AS recall, 2e0 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + fp) * 1e0 / n AS rate FROM c)
"""
    best = lambda v, on: f"arg_max(percent, ({v}, -percent)) FILTER ({v} IS NOT NULL AND {on})"
    add("pick_threshold", lambda spark, d: picked(scored(spark, d)), scored_sql + SWEPT + f"SELECT {best('f1', 'true')} AS by_f1, {best('recall', 'precision >= 0.5')} AS by_recall, {best('precision', 'rate BETWEEN 0.05 AND 0.6')} AS by_precision FROM m")
