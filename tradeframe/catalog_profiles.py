"""Queries of whole tables about traders, coins and blocks, and of money by score, with the SQL that gives the same rows.
Blocks are hours and bands are stretched, as the test tables are sparse."""

from __future__ import annotations

from tradeframe.operators import profiles, studies, trades, windows

HOUR, DAY = 3_600_000_000, 86_400_000_000
HOUR_MS, STRETCH, BIN_MINUTES = 3_600_000, 720.0, 3600.0
NAMES = [name for name, _ in windows.SPARSE.windows]


def register(add, r, by_norm, by_pairs, by_scored, round_amounts, window_sql, features) -> None:
    OUT, IN = "CASE WHEN swap_from_mint = 'SOL' THEN swap_from_amount END", "CASE WHEN swap_to_mint = 'SOL' THEN swap_to_amount END"
    SPAN = "(max(us) - min(us))"
    src, dst = "swap_from_mint = 'SOL'", "swap_to_mint = 'SOL'"
    percent = lambda on, name: r(f"count(*) FILTER ({on}) * 100e0 / count(*)", name)
    by_norm("trader_profile", profiles.trader_profile, f""", most AS (SELECT swapper, max(n) AS most FROM (SELECT swapper, mint, count(*) AS n FROM norm GROUP BY ALL) GROUP BY swapper)
SELECT swapper, count(*) AS trades, {r(f"coalesce(sum({OUT}), 0e0)", "sol_spent")}, {r(f"coalesce(sum({IN}), 0e0)", "sol_received")}, {r(f"avg({OUT})", "avg_size")}, {r(f"quantile_cont({OUT}, 0.5)", "median_size")}, {r(f"coalesce(max({OUT}), 0e0)", "max_size")},
  {r(f"min(CASE WHEN swap_from_mint = 'SOL' AND swap_from_amount > 0 THEN swap_from_amount END)", "min_size")}, {r(f"stddev_samp({OUT})", "std_size")}, {r(f"stddev_samp({OUT}) / nullif(avg({OUT}), 0)", "size_cv")}, {r(f"coalesce(sum({IN}), 0e0) - coalesce(sum({OUT}), 0e0)", "net_sol")},
  count(*) FILTER ({src}) AS sol_to_token_trades, count(*) FILTER ({dst}) AS token_to_sol_trades, count(*) FILTER (NOT ({src}) AND NOT ({dst})) AS token_to_token_trades, {r(f"count(*) FILTER ({src} AND {round_amounts}) * 1e0 / nullif(count(*) FILTER ({src}), 0)", "round_number_preference")},
  count(DISTINCT mint) AS unique_coins_traded, count(DISTINCT us // {HOUR}) AS active_hours, count(DISTINCT us // {DAY}) AS active_days, count(DISTINCT CASE WHEN NOT ({src}) THEN swap_from_mint END) AS unique_from_tokens_non_sol, count(DISTINCT CASE WHEN NOT ({dst}) THEN swap_to_mint END) AS unique_to_tokens_non_sol,
  {r("count(*) * 1e0 / count(DISTINCT mint)", "avg_trades_per_coin")}, {r("any_value(most) * 1e0 / count(*)", "trade_concentration_ratio")}, {r(f"{SPAN} / {DAY}e0", "trading_span_days")}, {r(f"count(*) / nullif({SPAN} / {DAY}e0, 0)", "trades_per_day")}, {r(f"{SPAN} / {HOUR}e0 / nullif(count(*) - 1, 0)", "avg_hours_between_trades")},
  {r(f"count(*) * 1e0 / count(DISTINCT us // {HOUR})", "trades_per_active_hour")}, {percent(src, "sol_to_token_percentage")}, {percent(dst, "token_to_sol_percentage")}, {percent(f"NOT ({src}) AND NOT ({dst})", "token_to_token_percentage")}, {r(f"count(*) FILTER ({src}) * 1e0 / nullif(count(*) FILTER ({dst}), 0)", "buy_sell_ratio")}
FROM norm JOIN most USING (swapper) GROUP BY swapper""")  # fmt: skip
    spent, back = "coalesce(sum(CASE WHEN is_buy THEN sol_amount END), 0e0)", "coalesce(sum(CASE WHEN is_sell THEN sol_amount END), 0e0)"
    by_norm("trader_total_pnl", lambda n: profiles.trader_total_pnl(trades.positions_in_order(n)), f""", held AS (SELECT swapper, mint, {back} - {spent} AS net FROM norm GROUP BY swapper, mint)
SELECT swapper, {r("sum(net)", "total_pnl")}, count(*) AS coins_traded, count(*) FILTER (net > 0) AS profitable_coins, {r("max(net)", "best")}, {r("min(net)", "worst")}, sum(net) > 0 AS is_profitable FROM held GROUP BY swapper""")  # fmt: skip
    paid, got = f"CASE WHEN is_buy AND {src} THEN swap_from_amount END", f"CASE WHEN is_sell AND {dst} THEN swap_to_amount END"
    z = lambda e, name: r(f"coalesce({e}, 0e0)", name)
    by_norm("coin_profile", profiles.coin_profile, f"""SELECT mint, count(*) AS total_transactions, min(us) AS first_us, max(us) AS last_us, {r(f"{SPAN} / {HOUR}e0", "time_span_hours")}, count(*) FILTER (is_buy) AS buy_transactions, count(*) FILTER (is_sell) AS sell_transactions,
  {r("count(*) FILTER (is_buy) * 1e0 / greatest(count(*) FILTER (is_sell), 1)", "buy_sell_ratio")}, {z(f"sum({paid})", "total_sol_in")}, {z(f"sum({got})", "total_sol_out")}, {z(f"avg({paid})", "avg_sol_per_buy")}, {z(f"avg({got})", "avg_sol_per_sell")}, {r(f"coalesce(sum({paid}), 0e0) - coalesce(sum({got}), 0e0)", "net_sol_flow")},
  count(DISTINCT swapper) AS unique_traders, {z(f"quantile_cont({paid}, 0.5)", "med_sol_per_buy")}, {z(f"quantile_cont({got}, 0.5)", "med_sol_per_sell")}, {z(f"count(*) / nullif({SPAN} / {HOUR}e0, 0)", "txns_per_hour")}, {z(f"count(DISTINCT swapper) / nullif({SPAN} / {HOUR}e0, 0)", "traders_per_hour")} FROM norm GROUP BY mint""")  # fmt: skip
    amount = f"CASE WHEN succeeded AND {src} THEN swap_from_amount WHEN succeeded AND {dst} THEN swap_to_amount END"
    other = "CASE WHEN swap_from_mint = mint THEN swap_to_mint WHEN swap_to_mint = mint THEN swap_from_mint END"
    by_norm("token_volume_table", profiles.token_volume_table, f"""SELECT mint, count(*) AS total_trades, count(*) FILTER (succeeded) AS successful_trades, {r(f"sum(coalesce({amount}, 0e0))", "total_sol_volume")}, {r(f"avg({amount})", "avg_sol_per_trade")}, {r(f"max(coalesce({amount}, 0e0))", "max_sol_trade")},
  min(us) AS first_us, max(us) AS last_us, count(*) FILTER ({other} = 'SOL') AS sol_pair_trades, count(*) FILTER ({other} <> 'SOL') AS non_sol_pair_trades, count(DISTINCT swapper) AS unique_traders, count(DISTINCT {other}) AS unique_pairs FROM norm GROUP BY mint""")  # fmt: skip
    price = "CASE WHEN sol_amount > 0 AND token_amount > 0 THEN sol_amount / token_amount END"
    bv, sv = "coalesce(sum(sol_amount) FILTER (is_buy), 0e0)", "coalesce(sum(sol_amount) FILTER (is_sell), 0e0)"
    DETAIL = f""", b AS (SELECT *, us // {HOUR} AS block, {price} AS price FROM pairs)
, g AS (SELECT mint, block, count(*) AS block_size, (max(us) - min(us)) / 1000 AS duration_ms, sum(sol_amount) AS total_volume, count(*) FILTER (is_buy) AS buy_count, count(*) FILTER (is_sell) AS sell_count, {bv} AS buy_volume, {sv} AS sell_volume, arg_min(is_buy, (us, row_index)) AS first_txn_is_buy, arg_max(is_buy, (us, row_index)) AS last_txn_is_buy,
    avg(sol_amount) AS avg_txn_size, max(sol_amount) AS largest_txn, arg_min(price, (us, row_index)) FILTER (price IS NOT NULL) AS price_start, arg_max(price, (us, row_index)) FILTER (price IS NOT NULL) AS price_end, min(price) AS price_min, max(price) AS price_max, count(price) AS prices, coalesce(stddev_samp(price), 0) AS sd, avg(price) AS mp
  FROM b GROUP BY mint, block HAVING count(*) >= 2 AND sum(sol_amount) > 0)
, d AS (SELECT *, (buy_count - sell_count) / block_size AS flow_imbalance, (buy_volume - sell_volume) / total_volume AS volume_imbalance, largest_txn / total_volume AS size_concentration, CASE WHEN prices > 1 AND mp > 0 THEN sd / mp WHEN prices > 0 THEN 0e0 END AS price_volatility, CASE WHEN prices > 1 AND price_start > 0 THEN (price_end - price_start) / price_start WHEN prices > 0 THEN 0e0 END AS price_change FROM g)
"""
    doubles = ("duration_ms", "total_volume", "buy_volume", "sell_volume", "avg_txn_size", "largest_txn", "price_start", "price_end", "price_min", "price_max", "price_volatility", "price_change", "flow_imbalance", "volume_imbalance", "size_concentration")
    by_pairs("block_detail", lambda p: profiles.block_detail(p, HOUR_MS), DETAIL + f"""SELECT mint, block, block_size, buy_count, sell_count, first_txn_is_buy, last_txn_is_buy, {", ".join(r(c, c) for c in doubles)}, CASE WHEN buy_count > sell_count THEN 'buy' ELSE 'sell' END AS dominant_direction,
  CASE WHEN flow_imbalance > 0.5 THEN 'strong buy' WHEN flow_imbalance > 0.1 THEN 'moderate buy' WHEN flow_imbalance >= -0.1 THEN 'balanced' WHEN flow_imbalance >= -0.5 THEN 'moderate sell' ELSE 'strong sell' END AS imbalance_band FROM d""")  # fmt: skip
    SEQ = f""", b AS (SELECT *, us // {HOUR} AS block, {price} AS price, avg(sol_amount) OVER (PARTITION BY mint, us // {HOUR}) AS mean FROM pairs)
, s0 AS (SELECT mint, block, string_agg(CASE WHEN is_buy THEN 'B' ELSE 'S' END, '' ORDER BY us, row_index) AS sides, string_agg(CASE WHEN sol_amount > mean THEN 'L' ELSE 'S' END, '' ORDER BY us, row_index) AS sizes FROM b GROUP BY mint, block HAVING count(*) >= 3 AND sum(sol_amount) > 0)
, m0 AS (SELECT mint, block, us, row_index, price - lag(price) OVER (PARTITION BY mint, block ORDER BY us, row_index) AS change FROM b WHERE price IS NOT NULL)
, m AS (SELECT mint, block, string_agg(CASE WHEN change > 0 THEN 'U' WHEN change < 0 THEN 'D' ELSE 'F' END, '' ORDER BY us, row_index) FILTER (change IS NOT NULL) AS moves FROM m0 GROUP BY mint, block)
, seq AS (SELECT s0.*, moves FROM s0 LEFT JOIN m USING (mint, block))
"""
    by_pairs("block_sequence_set", lambda p: profiles.block_sequences(p, HOUR_MS), SEQ + """SELECT *, NOT contains(sides, 'BB') AND NOT contains(sides, 'SS') AND length(sides) >= 4 AS alternating, contains(sides, 'BBB') AS clustered_buys, contains(sides, 'SSS') AS clustered_sells,
  contains(sides, 'BSB') AS sandwich_buy, contains(sides, 'SBS') AS sandwich_sell, sides LIKE '%BB' AS momentum_buy, sides LIKE '%SS' AS momentum_sell FROM seq""")  # fmt: skip
    by_pairs("pattern_counts", lambda p: profiles.pattern_counts(profiles.block_sequences(p, HOUR_MS)), SEQ + f"SELECT sides AS pattern, count(*) AS blocks, {r('count(*) * 100e0 / sum(count(*)) OVER ()', 'percent')} FROM seq GROUP BY sides ORDER BY blocks DESC, pattern LIMIT 10")

    def inside(low: float | None, high: float | None) -> str:
        return " AND ".join(x for x in (low is not None and f"gap > {low * STRETCH}", high is not None and f"gap <= {high * STRETCH}") if x)

    by_pairs("gap_statistics", lambda p: profiles.gap_statistics(p, STRETCH), f""", gaps AS (SELECT mint, (us - lag(us) OVER (PARTITION BY mint ORDER BY us, row_index)) / 1e6 AS gap FROM pairs)
SELECT mint, count(*) AS gaps, {r("min(gap)", "min_gap")}, {r("max(gap)", "max_gap")}, {r("avg(gap)", "mean_gap")}, {r("stddev_samp(gap)", "std_gap")}, {", ".join(r(f"quantile_cont(gap, {p / 100})", f"p{p}") for p in (10, 25, 50, 75, 90, 95, 99))},
  {", ".join(f"count(*) FILTER ({inside(*b)}) AS {n}, " + r(f"count(*) FILTER ({inside(*b)}) * 1e0 / count(*)", f"{n}_share") for n, b in profiles.BANDS.items())} FROM gaps WHERE gap IS NOT NULL GROUP BY mint""")  # fmt: skip
    short, long = NAMES[0], NAMES[1]
    bounds = {"per_trader": 40.0, "whales": 0.2, "size": 40.0}
    add("whale_regime", lambda spark, d: profiles.whale_regime(features(spark, d), short, long, **bounds).select("coin_id", "sample_us", "market_regime"),
        f"""SELECT coin_id, sample_us, CASE WHEN volume_per_trader_{long} > 40 AND whale_txn_ratio_{short} > 0.2 AND avg_txn_size_{long} > 40 THEN 'REGIME_2_WHALE_ACTIVITY' ELSE 'NORMAL_TRADING' END AS market_regime FROM ({window_sql(windows.SPARSE)})""")
    pnl = "(forward_buy - forward_sell)"
    SWEEP = """{head} CAST(p AS INTEGER) AS percent, count(*) AS total_trades, {cols} FROM data, range(10, 95, 5) t(p) WHERE score >= p / 100.0 GROUP BY ALL"""
    won, lost = f"sum({pnl}) FILTER ({pnl} > 0)", f"sum({pnl}) FILTER ({pnl} <= 0)"
    cols = ", ".join((r("count(*) * 1e0 / any_value(every)", "trade_rate"), r(f"avg({pnl})", "avg_profit"), r(f"sum({pnl})", "total_profit"), r(f"count(*) FILTER ({pnl} > 0) * 1e0 / count(*)", "win_rate"), z(f"avg({pnl}) FILTER ({pnl} > 0)", "avg_win"), z(f"avg({pnl}) FILTER ({pnl} <= 0)", "avg_loss"), z(f"abs({won} / nullif({lost}, 0))", "profit_factor"), z(f"avg({pnl}) / nullif(CASE WHEN count(*) > 1 THEN stddev_samp({pnl}) END, 0)", "sharpe_ratio")))
    by_scored("profit_sweep", profiles.profit_sweep, ", data AS (SELECT *, count(*) OVER () AS every FROM scored) " + SWEEP.format(head="SELECT", cols=cols))
    by_scored("profit_sweep_by_coin", lambda s: profiles.profit_sweep(s, by=["coin_id"]), ", data AS (SELECT *, count(*) OVER (PARTITION BY coin_id) AS every FROM scored) " + SWEEP.format(head="SELECT coin_id,", cols=cols))
    low, high, bins = 0.3, 0.8, 10
    edges = [low + (high - low) * i / bins for i in range(bins + 1)]
    place = " + ".join(f"CASE WHEN score >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in edges[1:])
    by_scored("score_bin_profits", lambda s: profiles.score_bin_profits(s, low, high, bins), f""", d AS (SELECT *, {pnl} AS pnl, {place} AS bin FROM scored WHERE score >= {low!r}::DOUBLE AND score <= {high!r}::DOUBLE)
, c AS (SELECT *, quantile_cont(abs(pnl), 0.95) OVER () AS cut FROM d)
SELECT CAST(bin AS INTEGER) AS bin, {r(f"({edges}::DOUBLE[])[bin + 1]", "from_score")}, {r(f"({edges}::DOUBLE[])[bin + 2]", "to_score")}, count(*) AS n, {r("avg(pnl)", "mean_pnl")}, {r("quantile_cont(pnl, 0.5)", "median_pnl")}, {r("stddev_samp(pnl)", "std_pnl")}, count(*) FILTER (abs(pnl) > cut) AS outliers,
  {r("count(*) FILTER (abs(pnl) > cut) * 1e0 / count(*)", "outlier_share")} FROM c WHERE bin < {bins} GROUP BY bin""")  # fmt: skip
    by_scored("auc_by_time", lambda s: studies.auc_by(profiles.with_time_bin(s, BIN_MINUTES), "time_bin"), f""", b AS (SELECT *, CAST(floor((sample_us - min(sample_us) OVER (PARTITION BY coin_id)) / {BIN_MINUTES * 6e7}) AS BIGINT) AS time_bin FROM scored)
, k AS (SELECT *, rank() OVER (PARTITION BY time_bin ORDER BY score) + (count(*) OVER (PARTITION BY time_bin, score) - 1) / 2e0 AS place FROM b)
, n AS (SELECT time_bin, count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y = 0 THEN 1 END) AS q, coalesce(sum(CASE WHEN y = 1 THEN place END), 0e0) AS s FROM k GROUP BY time_bin)
SELECT time_bin, p AS positives, q AS negatives, {r("(s - p * (p + 1) / 2e0) / nullif(p * q, 0)", "auc")} FROM n""")  # fmt: skip
