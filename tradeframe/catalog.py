"""Queries of the library's own operators, with the SQL that gives the same rows. Doubles are rounded here, not in the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe import catalog_candles, catalog_flow, catalog_models, catalog_profiles, catalog_returns, catalog_samples, catalog_serial, catalog_tables
from tradeframe.operators import bars, serial, signals, studies, trades, unit_root, windows
from tradeframe.sources.tables import TRADES_SQL, table
from tradeframe.sources.tables import trades as trades_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def round_all(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums of doubles depend on the order of their terms. As SQL does it, by the rounded product: Spark's
    round(c, 6) goes by the decimal digits, by which 23.49 / 7200 is below its half."""
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: round_all(make(spark, sf_dir))
    ORACLE_SQL[name] = sql


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.normalise_trades(trades_of(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.base_pairs(norm(spark, sf_dir))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.with_price(pairs(spark, sf_dir))


def by_norm(name: str, fn: Callable[[DataFrame], DataFrame], select: str) -> None:
    add(name, lambda spark, d: fn(norm(spark, d)), TRADES_SQL + select)


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


HOUR, DAY = 3_600_000_000, 86_400_000_000

add(
    "ohlc_block",
    lambda spark, d: trades.ohlc(priced(spark, d).withColumn("bar_us", F.floor(F.col("us") / HOUR) * HOUR), ["mint", "bar_us"]),
    TRADES_SQL + f"""SELECT mint, us // {HOUR} * {HOUR} AS bar_us, {r("arg_min(price, (us, row_index))", "open")}, {r("max(price)", "high")}, {r("min(price)", "low")},
  {r("arg_max(price, (us, row_index))", "close")}, {r("sum(price * sol_amount) / sum(sol_amount)", "vwap")}, {r("sum(sol_amount)", "sol_volume")},
  {r("sum(token_amount)", "token_volume")}, count(*) AS transactions, count(DISTINCT price) AS unique_prices, {r("stddev_samp(price)", "price_stddev")}
FROM priced_pairs GROUP BY ALL""",
)

SPENT = "coalesce(sum(CASE WHEN is_buy THEN sol_amount END), 0e0)"
BACK = "coalesce(sum(CASE WHEN is_sell THEN sol_amount END), 0e0)"
SIZE = "CASE WHEN sol_amount > 0 THEN sol_amount END"
OUT, IN = "CASE WHEN swap_from_mint = 'SOL' THEN swap_from_amount END", "CASE WHEN swap_to_mint = 'SOL' THEN swap_to_amount END"
by_norm("trader_volume", trades.trader_volume, f"""SELECT swapper, count(*) AS trades, {r(f"coalesce(sum({OUT}), 0e0)", "sol_spent")}, {r(f"coalesce(sum({IN}), 0e0)", "sol_received")}, {r(f"avg({OUT})", "avg_size")},
  {r(f"quantile_cont({OUT}, 0.5)", "median_size")}, {r(f"coalesce(max({OUT}), 0e0)", "max_size")}, {r(f"min(CASE WHEN swap_from_mint = 'SOL' AND swap_from_amount > 0 THEN swap_from_amount END)", "min_size")},
  {r(f"stddev_samp({OUT})", "std_size")}, {r(f"stddev_samp({OUT}) / nullif(avg({OUT}), 0)", "size_cv")}, {r(f"coalesce(sum({IN}), 0e0) - coalesce(sum({OUT}), 0e0)", "net_sol")} FROM norm GROUP BY swapper""")  # fmt: skip
by_norm("trader_diversification", trades.trader_diversification, f"""SELECT swapper, count(*) AS coins, CAST(sum(n) AS BIGINT) AS trades, {r("sum(n) * 1e0 / count(*)", "trades_per_coin")}, {r("max(n) * 1e0 / sum(n)", "max_share")}
FROM (SELECT swapper, mint, count(*) AS n FROM norm GROUP BY ALL) GROUP BY swapper""")  # fmt: skip
by_norm("trader_timing", trades.trader_timing, f"""SELECT swapper, {r("(max(us) - min(us)) / 3.6e9", "span_hours")}, count(DISTINCT us // {HOUR}) AS active_hours, count(DISTINCT us // {DAY}) AS active_days,
  {r("(max(us) - min(us)) / 3.6e9 / nullif(count(*) - 1, 0)", "mean_gap_hours")}, {r(f"count(*) * 1e0 / count(DISTINCT us // {HOUR})", "trades_per_active_hour")} FROM norm GROUP BY swapper""")  # fmt: skip
ROUNDS = """0.01, 0.05, 0.1, 0.2, 0.25, 0.5, 0.75, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 15.0, 20.0, 25.0, 50.0, 75.0, 100.0,
  150.0, 200.0, 250.0, 500.0, 750.0, 1000.0, 1500.0, 2000.0, 2500.0, 5000.0, 10000.0"""
IS_ROUND = f"swap_from_amount IN ({ROUNDS})"
by_norm("trader_round_numbers", trades.trader_round_numbers, f"""SELECT swapper, count(*) FILTER (swap_from_mint = 'SOL') AS base_trades, count(*) FILTER (swap_from_mint = 'SOL' AND {IS_ROUND}) AS round_trades,
  {r(f"count(*) FILTER (swap_from_mint = 'SOL' AND {IS_ROUND}) * 1e0 / nullif(count(*) FILTER (swap_from_mint = 'SOL'), 0)", "round_share")} FROM norm GROUP BY swapper""")  # fmt: skip
by_norm("trader_trade_types", trades.trader_trade_types, f"""SELECT swapper, count(CASE WHEN swap_from_mint = 'SOL' THEN 1 END) AS base_to_token, count(CASE WHEN swap_to_mint = 'SOL' THEN 1 END) AS token_to_base,
  count(CASE WHEN swap_from_mint <> 'SOL' AND swap_to_mint <> 'SOL' THEN 1 END) AS token_to_token, count(DISTINCT CASE WHEN swap_to_mint <> 'SOL' THEN swap_to_mint END) AS tokens_bought,
  count(DISTINCT CASE WHEN swap_from_mint <> 'SOL' THEN swap_from_mint END) AS tokens_sold,
  {r("count(CASE WHEN swap_from_mint = 'SOL' THEN 1 END) * 1e0 / nullif(count(CASE WHEN swap_to_mint = 'SOL' THEN 1 END), 0)", "buy_sell_ratio")} FROM norm GROUP BY swapper""")  # fmt: skip
HELD = f""", held AS (SELECT swapper, mint, {SPENT} AS spent, {BACK} AS back, count(CASE WHEN is_buy THEN 1 END) AS buys, count(CASE WHEN is_sell THEN 1 END) AS sells,
  count(*) AS n, (max(us) - min(us)) / 3.6e9 AS hours FROM norm GROUP BY swapper, mint)
"""
by_norm("positions", trades.positions, HELD + f"""SELECT swapper, mint, {r("spent", "sol_spent_on_coin")}, {r("back", "sol_received_from_coin")}, buys AS buy_trades, sells AS sell_trades, n AS total_coin_trades,
  {r("hours", "hours_active_on_coin")}, {r("back - spent", "net_sol_pnl_per_coin")}, {r("CASE WHEN spent > 0 THEN (back - spent) / spent END", "roi_on_coin")} FROM held""")  # fmt: skip
by_norm("trader_pnl", lambda n: trades.trader_pnl(trades.positions_in_order(n)), HELD + f"""SELECT swapper, count(*) AS positions, {r("count(CASE WHEN back - spent > 0 THEN 1 END) * 1e0 / count(*)", "win_rate")}, {r("avg(back - spent)", "avg_pnl")},
  {r("avg(CASE WHEN spent > 0 THEN (back - spent) / spent END)", "avg_roi")}, {r("sum(buys) * 1e0 / nullif(sum(sells), 0)", "buy_sell_ratio")} FROM held GROUP BY swapper""")  # fmt: skip
by_norm("coin_pnl", lambda n: trades.coin_pnl(trades.positions_in_order(n)), HELD + f"""SELECT mint, count(*) AS traders, {r("sum(back - spent)", "total_pnl")}, {r("avg(back - spent)", "avg_pnl")}, count(CASE WHEN back - spent > 0 THEN 1 END) AS winners FROM held GROUP BY mint""")
CLASS = "CASE WHEN sol_amount >= 100 THEN 'Whale' WHEN sol_amount >= 10 THEN 'Big' WHEN sol_amount >= 1 THEN 'Medium' WHEN sol_amount > 0 THEN 'Small' ELSE 'Unknown' END"
SPAN = "((max(us) - min(us)) / 6e7)"
by_norm("early_features", lambda n: trades.early_features(n, 48.0), f""", launch AS (SELECT mint, min(us) AS launch_us FROM norm GROUP BY mint)
SELECT swapper, g.mint, count(*) AS trade_count, {r("count(*) / 48e0", "trades_per_hour")}, {r(SPAN, "time_span_minutes")}, {r("sum(swap_from_amount)", "total_volume_traded")}, {r("avg(swap_from_amount)", "avg_trade_size")},
  {r("CASE WHEN avg(swap_from_amount) > 0 THEN stddev_samp(swap_from_amount) / avg(swap_from_amount) ELSE 0e0 END", "trade_size_cv")}, {r("max(swap_from_amount)", "largest_trade_size")},
  {r("CASE WHEN sum(swap_from_amount) > 0 THEN max(swap_from_amount) / sum(swap_from_amount) ELSE 0e0 END", "volume_concentration")}, count(DISTINCT swap_from_mint || '|' || swap_to_mint) AS unique_trading_pairs,
  {r("count(*) FILTER (swap_from_mint = 'SOL' OR swap_to_mint = 'SOL') * 1e0 / count(*)", "sol_involvement_ratio")}, {r("count(*) FILTER (swap_to_mint = g.mint) * 1e0 / count(*)", "buy_ratio")},
  {r(f"count(*) FILTER ({IS_ROUND}) * 1e0 / count(*)", "round_number_ratio")}, {r("count(DISTINCT swap_from_amount) * 1e0 / count(*)", "trade_size_diversity")},
  {r(f"CASE WHEN count(*) > 1 AND {SPAN} > 0 THEN {SPAN} * 60 / (count(*) - 1) ELSE 0e0 END", "avg_seconds_between_trades")}, {r("(min(us) - min(launch_us)) / 6e7", "first_trade_minutes")}
FROM norm g JOIN launch USING (mint) WHERE us < launch_us + {48 * HOUR} GROUP BY swapper, g.mint""")  # fmt: skip
by_norm("coin_summary", trades.coin_summary, f"""SELECT mint, count(*) AS trades, count(DISTINCT swapper) AS traders, {r("(max(us) - min(us)) / 3.6e9", "span_hours")}, {r("sum(CASE WHEN is_buy THEN sol_amount END)", "sol_in")},
  {r("sum(CASE WHEN is_sell THEN sol_amount END)", "sol_out")}, {r(f"quantile_cont({SIZE}, 0.5)", "median_size")}, count(CASE WHEN is_buy THEN 1 END) AS buys, count(CASE WHEN is_sell THEN 1 END) AS sells FROM norm GROUP BY mint""")  # fmt: skip
OTHER = "CASE WHEN mint = swap_to_mint THEN swap_from_mint ELSE swap_to_mint END"
by_norm("token_volumes", trades.token_volumes, f"""SELECT mint, {r(f"sum({SIZE})", "base_volume")}, {r(f"avg({SIZE})", "avg_base")}, {r(f"max({SIZE})", "max_base")}, count({SIZE}) AS base_trades,
  count(DISTINCT CASE WHEN {OTHER} <> 'SOL' THEN {OTHER} END) AS other_tokens, count(CASE WHEN {OTHER} <> 'SOL' THEN 1 END) AS other_trades FROM norm GROUP BY mint""")  # fmt: skip
by_norm("daily_stats", trades.daily_stats, f"SELECT CAST(block_timestamp AS DATE) AS day, count(*) AS trades, count(DISTINCT swapper) AS traders, count(DISTINCT mint) AS coins, {r('sum(sol_amount)', 'volume')} FROM norm GROUP BY ALL")
by_norm("hourly_pattern", trades.hourly_pattern, f"SELECT us // {HOUR} % 24 AS hour, count(*) AS trades, count(DISTINCT swapper) AS traders, {r('sum(sol_amount)', 'volume')} FROM norm GROUP BY ALL")
by_norm("pair_stats", trades.pair_stats, f"SELECT swap_from_mint, swap_to_mint, count(*) AS trades, count(DISTINCT swapper) AS traders, {r('avg(swap_from_amount)', 'avg_from')} FROM norm GROUP BY ALL")
by_norm("failed_share", trades.failed_share, f"SELECT succeeded, count(*) AS trades, {r('count(*) * 100e0 / sum(count(*)) OVER ()', 'percent')} FROM norm GROUP BY succeeded")
by_norm("summary_stats", trades.summary_stats, f"SELECT count(*) AS trades, count(DISTINCT swapper) AS traders, count(DISTINCT mint) AS coins, {r(f'quantile_cont({SIZE}, 0.5)', 'median_size')}, {r(f'quantile_cont({SIZE}, 0.95)', 'p95_size')} FROM norm")
by_norm("coins_per_trader", trades.coins_per_trader, f"SELECT coins, count(*) AS traders, {r('sum(count(*)) OVER (ORDER BY coins) * 1e0 / sum(count(*)) OVER ()', 'running_share')} FROM (SELECT swapper, count(DISTINCT mint) AS coins FROM norm GROUP BY swapper) GROUP BY coins")
by_norm("size_mix", trades.size_mix, f"SELECT {CLASS} AS size_class, count(*) AS trades, {r('sum(sol_amount)', 'volume')} FROM norm GROUP BY ALL")
by_norm("gap_profile", trades.gap_profile, f""", gaps AS (SELECT mint, (us - lag(us) OVER (PARTITION BY mint ORDER BY us, row_index)) / 1e6 AS gap FROM norm)
SELECT mint, count(*) AS gaps, {r("quantile_cont(gap, 0.5)", "median_gap")}, {r("quantile_cont(gap, 0.95)", "p95_gap")}, count(CASE WHEN gap < 60 THEN 1 END) AS under_minute, count(CASE WHEN gap >= 3600 THEN 1 END) AS over_hour FROM gaps WHERE gap IS NOT NULL GROUP BY mint""")  # fmt: skip
by_norm("dedup_trades", lambda n: trades.dedup(n, ["mint", "swapper", "swap_from_mint", "swap_to_mint", "succeeded"]), "SELECT mint, swapper, swap_from_mint, swap_to_mint, succeeded, min(row_index) AS row_index, count(*) AS copies FROM norm GROUP BY ALL")

#: Blocks of an hour: those of 100 ms hold one trade each here.
BLOCK_MS = 3_600_000
BUYS, SELLS = "sum(CASE WHEN is_buy THEN sol_amount ELSE 0e0 END)", "sum(CASE WHEN is_sell THEN sol_amount ELSE 0e0 END)"
SIDE = "CASE WHEN is_buy THEN 'B' ELSE 'S' END"
add("block_flow", lambda spark, d: trades.block_flow(priced(spark, d), BLOCK_MS), TRADES_SQL + f"""SELECT mint, us // {HOUR} AS block, count(*) AS trades, max(us) - min(us) AS duration_us, {r(BUYS, "buy_volume")}, {r(SELLS, "sell_volume")},
  {r(f"coalesce(({BUYS} - {SELLS}) / nullif({BUYS} + {SELLS}, 0), 0e0)", "imbalance")}, arg_min({SIDE}, (us, row_index)) AS first_side, arg_max({SIDE}, (us, row_index)) AS last_side,
  count(DISTINCT swapper) AS traders, {r("arg_min(price, (us, row_index))", "price_start")}, {r("arg_max(price, (us, row_index))", "price_end")} FROM priced_pairs GROUP BY ALL""")  # fmt: skip
add("block_sequences", lambda spark, d: trades.block_sequences(priced(spark, d), BLOCK_MS), TRADES_SQL + f""", seq AS (SELECT mint, us // {HOUR} AS block, string_agg({SIDE}, '' ORDER BY us, row_index) AS sequence FROM priced_pairs GROUP BY ALL)
SELECT *, NOT contains(sequence, 'BB') AND NOT contains(sequence, 'SS') AND length(sequence) > 1 AS alternating, contains(sequence, 'BBB') AS has_bbb, contains(sequence, 'SSS') AS has_sss FROM seq""")  # fmt: skip


def window_sql(cfg: windows.GridConfig) -> str:
    """The plain form: samples joined with their coin's trades by range."""
    columns = []
    for name, seconds in cfg.windows:
        w = f"b > 0 AND b <= {seconds * windows.SECOND}"
        v, bv, sv = (f"coalesce(sum(CASE WHEN {w}{x} THEN sol_amount END), 0e0)" for x in ("", " AND is_buy", " AND is_sell"))
        n, bn, sn = (f"count(CASE WHEN {w}{x} THEN 1 END)" for x in ("", " AND is_buy", " AND is_sell"))
        u, bu, su = (f"count(DISTINCT CASE WHEN {w}{x} THEN swapper END)" for x in ("", " AND is_buy", " AND is_sell"))
        ratio = lambda a, b: f"coalesce(({a}) * 1e0 / nullif({b}, 0), 0e0)"
        std = f"coalesce(stddev_pop(CASE WHEN {w} THEN sol_amount END), 0e0)"
        mean = f"coalesce(avg(CASE WHEN {w} THEN sol_amount END), 0e0)"
        kinds = {k: f"count(CASE WHEN {w} AND {c} THEN 1 END)" for k, c in (("small", "sol_amount > 0 AND sol_amount < 1"), ("medium", "sol_amount >= 1 AND sol_amount < 10"), ("big", "sol_amount >= 10 AND sol_amount < 100"), ("whale", "sol_amount >= 100"))}
        parts = {
            "total_volume": v, "buy_volume": bv, "sell_volume": sv, "buy_ratio": ratio(bv, v), "volume_imbalance": ratio(f"{bv} - {sv}", v), "total_txns": n, "buy_txns": bn, "sell_txns": sn,
            "txn_buy_ratio": ratio(bn, n), "txn_flow_imbalance": ratio(f"{bn} - {sn}", n), "unique_traders": u, "unique_buyers": bu, "unique_sellers": su, "trader_buy_ratio": ratio(bu, u),
            "avg_txn_size": mean, "volume_per_trader": ratio(v, u), "volume_concentration": ratio(std, mean), "volume_mean": mean, "volume_std": std, **{f"{k}_txn_ratio": ratio(c, n) for k, c in kinds.items()},
        }
        counts = ("txns", "traders", "buyers", "sellers")
        columns += [f"{e} AS {k}_{name}" if k.endswith(counts) else r(e, f"{k}_{name}") for k, e in parts.items()]
    fb, fs = (f"coalesce(sum(CASE WHEN b <= 0 AND b > -{cfg.forward * windows.SECOND} AND {x} THEN sol_amount END), 0e0)" for x in ("is_buy", "is_sell"))
    return TRADES_SQL + f""", spans AS (SELECT mint, min(us) + {cfg.buffer * windows.SECOND} AS anchor, max(us) - {cfg.forward * windows.SECOND} AS last, count(*) AS total FROM pairs GROUP BY mint HAVING count(*) >= {cfg.least_trades})
, grid AS (SELECT mint, anchor + {cfg.step * windows.SECOND} * unnest(range(0, (last - anchor) // {cfg.step * windows.SECOND} + 1)) AS sample_us, total FROM spans WHERE anchor < last)
, near AS (SELECT g.mint AS coin_id, sample_us, total, sample_us - us AS b, is_buy, is_sell, swapper, sol_amount FROM grid g LEFT JOIN pairs p ON p.mint = g.mint AND us <= sample_us + {cfg.forward * windows.SECOND} AND us >= sample_us - {max(s for _, s in cfg.windows) * windows.SECOND})
SELECT coin_id, sample_us, total AS total_transactions, {", ".join(columns)}, {r(fb, "forward_buy_volume_300s")}, {r(fs, "forward_sell_volume_300s")}, CAST({fb} > {fs} AS INTEGER) AS is_profitable_300s FROM near GROUP BY coin_id, sample_us, total"""


add("window_features", lambda spark, d: windows.window_features(pairs(spark, d), windows.SPARSE), window_sql(windows.SPARSE))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars_of(table(spark, sf_dir, "events"))


BARS_SQL = f"""WITH bars AS (SELECT event_type AS symbol, epoch_us(ts) // {HOUR} * {HOUR} AS us, arg_min(value, (epoch_us(ts), event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (epoch_us(ts), event_id)) AS close, sum(value) AS volume, count(*) AS transactions FROM events GROUP BY ALL)
, ret AS (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY us))
"""


def by_bars(name: str, fn: Callable[[DataFrame], DataFrame], select: str) -> None:
    add(name, lambda spark, d: fn(hourly(spark, d)), BARS_SQL + select)


QUERIES["unit_roots"] = lambda spark, d: round_all(unit_root.augmented_dickey_fuller(bars.with_returns(hourly(spark, d)), "symbol", "us", "r"))  # beyond SQL: tested against plain regressions
by_bars("resample_bars", lambda b: bars.resample(b, 14_400), f"SELECT symbol, us // {4 * HOUR} * {4 * HOUR} AS start_us, {r('arg_min(open, us)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('arg_max(close, us)', 'close')}, {r('sum(volume)', 'volume')}, CAST(sum(transactions) AS BIGINT) AS transactions FROM bars GROUP BY ALL")
by_bars("bar_quality", bars.bar_quality, "SELECT symbol, count(*) AS bars, count(CASE WHEN high < greatest(open, close) THEN 1 END) AS high_below, count(CASE WHEN low > least(open, close) THEN 1 END) AS low_above, count(CASE WHEN least(open, high, low, close) <= 0 THEN 1 END) AS not_positive, count(CASE WHEN volume <= 0 THEN 1 END) AS no_volume FROM bars GROUP BY symbol")
by_bars("return_profile", bars.return_profile, f"SELECT symbol, count(r) AS n, {r('avg(r)', 'mean')}, {r('stddev_samp(r)', 'std')}, {r('skewness(r)', 'skew')}, {r('kurtosis(r)', 'kurtosis')}, {r('quantile_cont(r, 0.05)', 'p05')}, {r('quantile_cont(r, 0.5)', 'p50')}, {r('quantile_cont(r, 0.95)', 'p95')} FROM ret WHERE r IS NOT NULL GROUP BY symbol")
UP, DOWN = "sum(CASE WHEN close > open THEN volume ELSE 0e0 END)", "sum(CASE WHEN close < open THEN volume ELSE 0e0 END)"
by_bars("intraday_profile", bars.intraday_profile, f"SELECT symbol, us // {HOUR} % 24 AS hour, {r('avg(close - open)', 'mean_move')}, {r('stddev_samp(close - open)', 'std_move')}, count(*) AS n, {r(f'{UP} / nullif({DOWN}, 0)', 'up_down')} FROM bars GROUP BY ALL")
by_bars("day_gaps", bars.day_gaps, f", days AS (SELECT symbol, us // {DAY} AS day, count(*) AS n FROM bars GROUP BY ALL), m AS (SELECT *, avg(n) OVER w AS mean_n, stddev_samp(n) OVER w AS std_n FROM days WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) SELECT symbol, day, n, {r('mean_n', 'mean_n')}, {r('std_n', 'std_n')}, n < mean_n - 2 * std_n AS is_gap FROM m")
by_bars("volatility", bars.volatility, f", s AS (SELECT symbol, us, close, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END AS vol, CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END AS ma, CASE WHEN count(close) OVER w >= 10 THEN stddev_samp(close) OVER w END AS sd FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, us, {r('vol', 'vol')}, {r('(close - ma) / nullif(sd, 0)', 'zscore')} FROM s")
by_bars("drawdown", bars.drawdown, f"SELECT symbol, us, {r('close', 'close')}, {r('close / max(close) OVER (PARTITION BY symbol ORDER BY us) - 1', 'drawdown')} FROM bars")
by_bars("forward_returns", bars.forward_returns, f"SELECT symbol, us, {r('lead(close, 4) OVER (PARTITION BY symbol ORDER BY us) / nullif(close, 0)', 'growth')} FROM bars")
LAGS = ", ".join(f"lag(r, {k}) OVER w AS r{k}" for k in (1, 2, 5))
CORRS = ", ".join(r(f"covar_pop(r, r{k}) / nullif(stddev_pop(CASE WHEN r{k} IS NOT NULL THEN r END) * stddev_pop(r{k}), 0)", f"autocorr_{k}") for k in (1, 2, 5))
by_bars("mean_reversion", bars.mean_reversion, f", l AS (SELECT symbol, r, {LAGS} FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY us)) SELECT symbol, count(*) AS n, {CORRS} FROM l GROUP BY symbol")

add("next_prices", lambda spark, d: studies.next_prices(priced(spark, d), (3_600, 86_400)), TRADES_SQL + f""", q AS (SELECT mint, us, arg_min(price, row_index) AS price FROM priced_pairs GROUP BY ALL)
, asked AS (SELECT mint, us, price, CAST(horizon AS INTEGER) AS horizon, us + CAST(horizon AS BIGINT) * 1000000 AS due FROM q, (SELECT unnest([3600, 86400]) AS horizon))
SELECT a.mint, a.us, a.horizon, {r("a.price", "price")}, q.us AS next_us, {r("q.price", "next_price")} FROM asked a ASOF LEFT JOIN q ON a.mint = q.mint AND a.due <= q.us""")  # fmt: skip
by_norm("trade_overview", studies.overview, "SELECT count(*) AS trades, count(DISTINCT swapper) AS traders, count(DISTINCT mint) AS coins, count(CASE WHEN is_buy THEN 1 END) AS buys, count(CASE WHEN is_sell THEN 1 END) AS sells, min(us) AS first_us, max(us) AS last_us FROM norm")
by_norm("launched_since", lambda n: studies.launched_since(n, 0), "SELECT mint, min(us) AS first_us, max(us) AS last_us, count(*) AS trades, count(DISTINCT swapper) AS traders, count(CASE WHEN succeeded THEN 1 END) AS succeeded FROM norm GROUP BY mint HAVING min(us) >= 0")
SPAN = "(max(us) - min(us)) / 3.6e9"
by_norm("token_rates", studies.token_rates, f"SELECT mint, {r(SPAN, 'hours')}, {r('count(*) * 1e0 / count(DISTINCT swapper)', 'trades_per_trader')}, {r(f'count(*) / ({SPAN} + 0.1e0)', 'trades_per_hour')}, {r('sum(sol_amount) / count(DISTINCT swapper)', 'volume_per_trader')} FROM norm GROUP BY mint")
by_norm("top_trades_by_coin", lambda n: studies.top_n_by(n.select("mint", "swapper", "row_index", "sol_amount"), ["mint"], [F.col("sol_amount").desc(), F.col("row_index")], 10),
        f"SELECT mint, swapper, row_index, {r('sol_amount', 'sol_amount')}, CAST(row_number() OVER (PARTITION BY mint ORDER BY sol_amount DESC, row_index) AS INTEGER) AS place FROM norm QUALIFY place <= 10")
BY_TIME = "WINDOW w AS (PARTITION BY symbol ORDER BY us"
by_bars("buy_feasible", lambda b: studies.buy_feasible(b, 100.0), f"SELECT symbol, us, coalesce(lead(volume) OVER w >= 100 AND lead(low) OVER w < lead(open) OVER w, false) AS can_buy FROM bars {BY_TIME})")
by_bars("first_liquid_exit", lambda b: studies.first_liquid_exit(b, 2.0), f"SELECT symbol, us, min(CASE WHEN volume >= 2 * open THEN us END) OVER w AS exit_us FROM bars {BY_TIME} ROWS BETWEEN 4 FOLLOWING AND 13 FOLLOWING)")
by_bars("any_next", lambda b: studies.any_next(b, F.col("close") < F.col("open"), 3), f"SELECT symbol, us, coalesce(bool_or(close < open) OVER w, false) AS any_next FROM bars {BY_TIME} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)")
by_bars("daily_frame", studies.daily_frame, f""", d AS (SELECT symbol, us // {DAY} AS day, arg_min(open, us) AS open, max(high) AS high, min(low) AS low, arg_max(close, us) AS close, sum(volume) AS volume,
  arg_max(close, us) FILTER (us % {DAY} < {6 * HOUR}) AS early_close, sum(volume) FILTER (us % {DAY} < {6 * HOUR}) AS early_volume FROM bars GROUP BY ALL)
SELECT symbol, day, {", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume", "early_close", "early_volume"))}, {r("close / nullif(open, 0) - 1", "intraday")},
  {r("open / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1", "gap")} FROM d""")  # fmt: skip


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a score: a window's share of buy volume, which is fixed, so that SQL has it too."""
    first = windows.SPARSE.windows[0][0]
    rows = windows.window_features(pairs(spark, sf_dir), windows.SPARSE)
    forward = {f"forward_{k}": F.round(f"forward_{k}_volume_300s", 6) for k in ("buy", "sell")}
    return rows.select("coin_id", "sample_us", F.col("is_profitable_300s").alias("y"), F.round(f"buy_ratio_{first}", 6).alias("score"), *[v.alias(k) for k, v in forward.items()])


SCORED_SQL = f"""WITH scored AS (SELECT coin_id, sample_us, is_profitable_300s AS y, buy_ratio_{windows.SPARSE.windows[0][0]} AS score, forward_buy_volume_300s AS forward_buy, forward_sell_volume_300s AS forward_sell FROM ({window_sql(windows.SPARSE)}))
"""


def by_scored(name: str, fn: Callable[[DataFrame], DataFrame], select: str) -> None:
    add(name, lambda spark, d: fn(scored(spark, d)), SCORED_SQL + select)


by_scored("threshold_sweep", studies.threshold_sweep, f""", c AS (SELECT CAST(p AS INTEGER) AS percent, count(CASE WHEN score >= p / 100.0 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN score >= p / 100.0 AND y = 0 THEN 1 END) AS fp,
  count(CASE WHEN score < p / 100.0 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN score < p / 100.0 AND y = 0 THEN 1 END) AS tn FROM scored, range(10, 91, 5) t(p) GROUP BY p)
SELECT percent, tp, fp, fn, tn, {r("tp * 1e0 / nullif(tp + fp, 0)", "precision")}, {r("tp * 1e0 / nullif(tp + fn, 0)", "recall")}, {r("2e0 * tp / nullif(2 * tp + fp + fn, 0)", "f1")}, {r("(tp + fp) * 1e0 / (tp + fp + fn + tn)", "signal_rate")} FROM c""")  # fmt: skip
by_scored("auc_by_coin", lambda s: studies.auc_by(s, "coin_id"), f""", k AS (SELECT *, rank() OVER (PARTITION BY coin_id ORDER BY score) + (count(*) OVER (PARTITION BY coin_id, score) - 1) / 2e0 AS place FROM scored)
, n AS (SELECT coin_id, count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y = 0 THEN 1 END) AS q, coalesce(sum(CASE WHEN y = 1 THEN place END), 0e0) AS s FROM k GROUP BY coin_id)
SELECT coin_id, p AS positives, q AS negatives, {r("(s - p * (p + 1) / 2e0) / nullif(p * q, 0)", "auc")} FROM n""")  # fmt: skip
by_scored("score_bins", studies.score_bins, f"SELECT CAST(floor(score * 20) AS BIGINT) AS bin, count(*) AS n, {r('avg(y)', 'positive_share')}, {r('avg(forward_buy - forward_sell)', 'mean_net')} FROM scored GROUP BY ALL")
by_scored("confidence_bands", studies.confidence_bands, f"SELECT CASE WHEN score >= 0.8 THEN 'high' WHEN score <= 0.2 THEN 'low' ELSE 'between' END AS band, count(*) AS n, {r('avg(CASE WHEN CAST(score >= 0.5 AS INTEGER) = y THEN 1e0 ELSE 0e0 END)', 'accuracy')} FROM scored GROUP BY ALL")
by_scored("hours_since_start", studies.hours_since_start, f", h AS (SELECT coin_id, sample_us, (sample_us - min(sample_us) OVER (PARTITION BY coin_id)) / 3.6e9 AS hours FROM scored) SELECT coin_id, sample_us, {r('hours', 'hours')}, hours BETWEEN 1 AND 10 AS in_window FROM h")

SHAPE = ", s AS (SELECT *, high - low AS spread, (high - low) / nullif(close, 0) * 100 AS pct, lag(close) OVER w AS before FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY us))"
by_bars("bar_shape", signals.bar_shape, f"{SHAPE} SELECT symbol, us, {r('spread', 'hl_spread')}, {r('pct', 'hl_spread_pct')}, {r('(high + low) / 2', 'midpoint')} FROM s")
MINUTE = "us // 60000000 % 1440"
by_bars("calendar", signals.calendar, f"SELECT symbol, us, {MINUTE} // 60 AS hour, {MINUTE} AS minute, CAST(dayofweek(make_timestamp(us)) + 1 AS INTEGER) AS weekday, CAST(quarter(make_timestamp(us)) AS INTEGER) AS quarter, CASE WHEN {MINUTE} >= 570 AND {MINUTE} < 960 THEN 'regular' ELSE 'extended' END AS session FROM bars")
by_bars("spread_bounce", signals.spread_bounce, f"""{SHAPE}, c AS (SELECT symbol, quantile_cont(pct, 0.25) AS low_cut, quantile_cont(pct, 0.75) AS high_cut FROM s GROUP BY symbol)
, a AS (SELECT s.*, low_cut, high_cut, min(pct) OVER w AS least, count(*) OVER w AS behind FROM s JOIN c USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
, b AS (SELECT *, pct > high_cut AS wide, pct > high_cut AND behind = 3 AND least < low_cut AS bounced FROM a)
SELECT symbol, {r("avg(spread)", "mean")}, {r("quantile_cont(spread, 0.5)", "median")}, {r("stddev_samp(spread)", "std")}, {r("avg(pct)", "mean_pct")}, {r("corr(pct, volume)", "volume_corr")}, count(CASE WHEN wide THEN 1 END) AS wide,
  count(CASE WHEN bounced THEN 1 END) AS bounced, {r("count(CASE WHEN bounced THEN 1 END) * 1e0 / nullif(count(CASE WHEN wide THEN 1 END), 0)", "bounce_rate")} FROM b GROUP BY symbol""")  # fmt: skip
LAGGED = (1, 2, 3, 5, 10)
by_bars("volatility_clustering", signals.volatility_clustering, f"""{SHAPE}, l AS (SELECT *, {", ".join(f"lag(r, {k}) OVER w AS r_{k}" for k in LAGGED)},
  {", ".join(f"CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS vol_{n}" for n in (5, 20))}
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY us))
SELECT symbol, {", ".join(r(f"corr(abs(r), abs(r_{k}))", f"abs_autocorr_{k}") for k in LAGGED)}, {", ".join(r(f"corr(r * r, r_{k} * r_{k})", f"square_autocorr_{k}") for k in LAGGED)}, {", ".join(r(f"corr(vol_{n}, pct)", f"vol_{n}_spread_corr") for n in (5, 20))} FROM l GROUP BY symbol""")  # fmt: skip
by_bars("price_impact", signals.price_impact, f"""{SHAPE}, n AS (SELECT *, lead(abs(r)) OVER w AS next_size, lead(pct) OVER w AS next_spread FROM s WINDOW w AS (PARTITION BY symbol ORDER BY us))
SELECT symbol, {r("corr(volume, abs(r))", "return_corr")}, {r("corr(volume, next_size)", "next_return_corr")}, {r("corr(volume, next_spread)", "next_spread_corr")} FROM n GROUP BY symbol""")  # fmt: skip
by_bars("volume_quartiles", signals.volume_quartiles, f"""{SHAPE}, c AS (SELECT symbol, quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.5) AS b, quantile_cont(volume, 0.75) AS d FROM s GROUP BY symbol)
SELECT symbol, 1 + CAST(volume > a AS INTEGER) + CAST(volume > b AS INTEGER) + CAST(volume > d AS INTEGER) AS quartile, count(*) AS n, {r("avg(abs(r))", "mean_abs_return")}, {r("avg(pct)", "mean_spread_pct")} FROM s JOIN c USING (symbol) GROUP BY ALL""")  # fmt: skip
by_bars("volume_entries", serial.volume_entries, f""", q AS (SELECT symbol, us, close, volume, CASE WHEN count(close) OVER a >= 20 THEN avg(close) OVER a END AS ma, CASE WHEN count(close) OVER a >= 20 THEN stddev_samp(close) OVER a END AS sd, list(volume) OVER b AS past, lead(close, 5) OVER (PARTITION BY symbol ORDER BY us) AS later
  FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
, z AS (SELECT *, (close - ma) / nullif(sd, 0) AS zscore, CASE WHEN len(past) = 100 THEN len(list_filter(past, lambda v: v < volume)) + (len(list_filter(past, lambda v: v = volume)) + 1) / 2e0 END AS volume_rank FROM q)
, g AS (SELECT *, CASE WHEN volume_rank >= 80 AND zscore <= -2 THEN 1 WHEN volume_rank >= 80 AND zscore >= 2 THEN -1 ELSE 0 END AS signal FROM z)
SELECT symbol, us, {r("zscore", "zscore")}, {r("volume_rank", "volume_rank")}, signal, {r("signal * (later / nullif(close, 0) - 1)", "signal_return")} FROM g""")  # fmt: skip
by_bars("daily_strategies", signals.daily_strategies, f""", d AS (SELECT symbol, us // {DAY} AS day, arg_min(open, us) AS open, arg_max(close, us) AS close, arg_max(close, us) FILTER (us % {DAY} < {6 * HOUR}) AS early_close, sum(volume) FILTER (us % {DAY} < {6 * HOUR}) AS early_volume FROM bars GROUP BY ALL)
, e AS (SELECT *, lead(open) OVER w AS next_open, lag(close) OVER w AS before, avg(early_volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean_volume FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
, f AS (SELECT *, close / nullif(before, 0) - 1 AS held, close / nullif(open, 0) - 1 AS intraday, close / nullif(early_close, 0) - 1 AS rest, open / nullif(before, 0) - 1 AS gap FROM e)
, g AS (SELECT *, CASE WHEN count(held) OVER w >= 10 THEN stddev_samp(held) OVER w END AS vol FROM f WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, day, {r("intraday", "open_close")}, {r("next_open / nullif(close, 0) - 1", "close_open")}, {r("CASE WHEN early_close < open THEN rest ELSE 0e0 END", "reversal")}, {r("CASE WHEN gap > 0.01e0 THEN 1 WHEN gap < -0.01e0 THEN -1 ELSE 0 END * intraday", "gap_and_go")},
  {r("CASE WHEN early_volume > mean_volume THEN intraday ELSE 0e0 END", "volume_filter")}, {r("CASE WHEN early_close > before * (1 + vol) OR early_close < before * (1 - vol) THEN rest ELSE 0e0 END", "breakout")} FROM g""")  # fmt: skip
by_bars("time_scales", signals.time_scales, f""", v AS (SELECT symbol, CAST(h AS INTEGER) AS hours, us // (h * {HOUR}) AS slot, sum(volume) AS volume FROM bars, (SELECT unnest([1, 2, 4, 8, 24]) AS h) GROUP BY ALL)
, l AS (SELECT *, lag(volume) OVER (PARTITION BY symbol, hours ORDER BY slot) AS before FROM v)
SELECT symbol, hours, count(*) AS slots, {r("corr(volume, before)", "autocorr")}, {r("avg(volume) / nullif(stddev_samp(volume), 0)", "signal_noise")} FROM l GROUP BY ALL""")  # fmt: skip
POINTS = ", ".join(f"quantile_cont(close, {p}) AS p{round(p * 100):02}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
by_bars("describe_close", lambda b: signals.describe(b, "close"), f""", q AS (SELECT symbol, {POINTS}, count(close) AS n, avg(close) AS mean, stddev_samp(close) AS std, min(close) AS least, max(close) AS greatest FROM bars GROUP BY symbol)
, o AS (SELECT symbol, count(CASE WHEN close < p25 - 1.5 * (p75 - p25) OR close > p75 + 1.5 * (p75 - p25) THEN 1 END) AS outliers FROM bars JOIN q USING (symbol) GROUP BY symbol)
SELECT symbol, n, {", ".join(r(c, c) for c in ("mean", "std", "least", "greatest", "p01", "p05", "p25", "p50", "p75", "p95", "p99"))}, outliers FROM q JOIN o USING (symbol)""")  # fmt: skip
by_bars("filled_grid", signals.filled_grid, f""", t AS (SELECT symbol, unnest(range(min(us), max(us) + 1, {HOUR})) AS us FROM bars GROUP BY symbol)
SELECT t.symbol, t.us, {", ".join(r(f"CASE WHEN b.us = t.us THEN b.{c} ELSE b.close END", c) for c in ("open", "high", "low"))}, {r("b.close", "close")}, {r("CASE WHEN b.us = t.us THEN b.volume ELSE 0e0 END", "volume")} FROM t ASOF JOIN bars b ON t.symbol = b.symbol AND t.us >= b.us""")  # fmt: skip

by_norm("trader_size_class", signals.trader_size_class, f"SELECT swapper, {r('max(sol_amount)', 'largest')}, {CLASS.replace('sol_amount', 'max(sol_amount)')} AS size_class FROM norm GROUP BY swapper")
LEG = lambda c: f"CASE WHEN {c} = mint THEN 'coin' WHEN {c} = 'SOL' THEN 'base' ELSE 'other' END"
by_norm("pair_breakdown", lambda n: signals.pair_breakdown(n, "SOL"), f"SELECT mint, {LEG('swap_from_mint')} AS from_kind, {LEG('swap_to_mint')} AS to_kind, CASE WHEN swap_from_mint = mint THEN swap_to_mint ELSE swap_from_mint END AS counter, count(*) AS trades, count(DISTINCT swapper) AS traders, {r('sum(sol_amount)', 'base_volume')} FROM norm GROUP BY ALL")
by_norm("first_day", signals.first_day, f""", legs AS (SELECT swap_from_mint AS token, us // {DAY} AS day, swapper, sol_amount FROM norm UNION ALL SELECT swap_to_mint, us // {DAY}, swapper, sol_amount FROM norm WHERE swap_to_mint <> swap_from_mint)
SELECT token, day, count(*) AS trades, count(DISTINCT swapper) AS traders, {r("sum(sol_amount)", "base_volume")} FROM legs WHERE (token, day) IN (SELECT (token, min(day)) FROM legs GROUP BY token) GROUP BY ALL""")  # fmt: skip
add("trader_sequences", lambda spark, d: signals.trader_sequences(priced(spark, d), BLOCK_MS), TRADES_SQL + f""", p AS (SELECT mint, us // {HOUR} AS block, us, row_index, swapper, {SIDE} AS side, lag(swapper) OVER (PARTITION BY mint, us // {HOUR} ORDER BY us, row_index) AS before FROM priced_pairs)
SELECT mint, block, CAST(count(*) AS INTEGER) AS trades, count(DISTINCT swapper) AS traders, CAST(count(CASE WHEN swapper = before THEN 1 END) AS INTEGER) AS same, count(DISTINCT swapper) = 2 AND count(CASE WHEN swapper <> before THEN 1 END) >= count(*) - 2 AS alternating,
  string_agg(CASE WHEN before IS NULL THEN 'T1' WHEN swapper = before THEN 'Same' ELSE 'New' END || side, '' ORDER BY us, row_index) AS sequence FROM p GROUP BY mint, block HAVING count(*) >= 3""")  # fmt: skip
IMPACT_SQL = TRADES_SQL + """, m AS (SELECT *, (price - lag(price) OVER w) / lag(price) OVER w AS change FROM priced_pairs WINDOW w AS (PARTITION BY mint ORDER BY us, row_index))
, near AS (SELECT e.mint, e.row_index AS event, threshold, window_s, e.change, e.price AS p, q.price, q.us, q.row_index, q.sol_amount FROM m e, (SELECT unnest([0.1e0, 0.3e0]) AS threshold), (SELECT unnest([3600, 43200]) AS window_s), priced_pairs q
  WHERE abs(e.change) >= threshold AND q.mint = e.mint AND q.us >= e.us AND q.us <= e.us + CAST(window_s AS BIGINT) * 1000000)
, g AS (SELECT mint, event, threshold, CAST(window_s AS INTEGER) AS window_s, change, (arg_max(price, (us, row_index)) - p) / p AS reversion, CASE WHEN change > 0 THEN (p - min(price)) / p ELSE (max(price) - p) / p END AS best_move, count(*) AS trades, sum(sol_amount) AS volume FROM near GROUP BY mint, event, threshold, window_s, change, p)
, i AS (SELECT *, CASE WHEN change > 0 THEN -reversion ELSE reversion END AS strength FROM g)
"""


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.impact_events(priced(spark, sf_dir), (0.1, 0.3), (3_600, 43_200))


add("impact_events", impacts, IMPACT_SQL + f"SELECT mint, event, threshold, window_s, {', '.join(r(c, c) for c in ('change', 'reversion', 'strength', 'best_move'))}, trades, {r('volume', 'volume')} FROM i")
add("impact_summary", lambda spark, d: signals.impact_summary(impacts(spark, d)), IMPACT_SQL + f"SELECT threshold, window_s, count(*) AS events, {r('avg(strength)', 'mean_strength')}, {r('avg(best_move)', 'mean_best')}, {r('count(CASE WHEN strength > 0 THEN 1 END) * 1e0 / count(*)', 'win_rate')} FROM i GROUP BY ALL")
YES, NO = "CASE WHEN is_buy THEN sol_amount END", "CASE WHEN NOT is_buy THEN sol_amount END"
by_norm("buy_sell_t", lambda n: signals.two_sample_t(n, "mint", "is_buy", "sol_amount"), f""", g AS (SELECT mint, count({YES}) AS n, count({NO}) AS m, avg({YES}) AS a, avg({NO}) AS b, var_samp({YES}) AS v, var_samp({NO}) AS u FROM norm GROUP BY mint)
SELECT mint, n AS n_yes, m AS n_no, {r("a", "mean_yes")}, {r("b", "mean_no")}, {r("CASE WHEN n > 1 AND m > 1 THEN (a - b) / nullif(sqrt(((n - 1) * v + (m - 1) * u) / (n + m - 2) * (1e0 / n + 1e0 / m)), 0) END", "t")} FROM g""")  # fmt: skip
by_norm("size_side_chi_square", lambda n: signals.chi_square(n, trades.size_category(F.col("sol_amount")), F.col("mint")), f""", c AS (SELECT {CLASS} AS "row", mint AS "column", count(*) AS n FROM norm GROUP BY ALL)
, e AS (SELECT *, sum(n) OVER (PARTITION BY "row") * 1e0 * sum(n) OVER (PARTITION BY "column") / sum(n) OVER () AS expected, sum(n) OVER () AS every FROM c)
SELECT "row", "column", n, {r("expected", "expected")}, {r("sum(n * n / expected) OVER () - every", "chi_square")} FROM e""")  # fmt: skip
by_scored("every_fifth_sample", lambda s: signals.every_nth(s.select("coin_id", "sample_us", "score"), "coin_id", "sample_us", 5), f"SELECT coin_id, sample_us, {r('score', 'score')} FROM scored QUALIFY (row_number() OVER (PARTITION BY coin_id ORDER BY sample_us) - 1) % 5 = 0")
FEATURES, TARGETS = ("score",), ("y", "forward_buy", "forward_sell")
by_scored("score_correlations", lambda s: signals.corr_screen(s, FEATURES, TARGETS), ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS target, corr({f}, {t}) AS r, count({f} + {t}) AS n FROM scored" for f in FEATURES for t in TARGETS) + f") SELECT feature, target, {r('r', 'r')}, n, {r('r * sqrt(n - 2) / nullif(sqrt(1 - r * r), 0)', 't')} FROM c")

catalog_tables.register(add, r)
catalog_flow.register(add, r, by_bars)
catalog_models.register(add, r, by_scored, QUERIES)
for name, (query, sql) in (catalog_samples.ALL | catalog_serial.ALL).items():
    add(name, query, sql)


def by_pairs(name: str, fn: Callable[[DataFrame], DataFrame], select: str) -> None:
    add(name, lambda spark, d: fn(pairs(spark, d)), TRADES_SQL + select)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(windows.window_features(pairs(spark, sf_dir), windows.SPARSE))


catalog_profiles.register(add, r, by_norm, by_pairs, by_scored, IS_ROUND, window_sql, features)
catalog_returns.register(add, r, by_bars, by_norm, features, window_sql)
catalog_candles.register(add, r, by_norm, scored, priced, pairs, SCORED_SQL, TRADES_SQL, ORACLE_SQL["token_volume_table"].removeprefix(TRADES_SQL))
