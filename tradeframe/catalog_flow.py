"""Queries of order flow and price impact, with the SQL that gives the same rows. Blocks are hours, as those of 100 ms hold one trade each here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeframe.operators import flow, impact, reversal, studies, trades
from tradeframe.sources.tables import TRADES_SQL
from tradeframe.sources.tables import trades as trades_of

HOUR_MS, HOURS = 3_600_000, (3600, 7200)
DAY = 86_400_000_000


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.base_pairs(trades.normalise_trades(trades_of(spark, sf_dir)))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.with_price(pairs(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.block_signals(pairs(spark, sf_dir), HOUR_MS)


def finite(expression: str) -> str:
    return f"CASE WHEN isfinite({expression}) THEN {expression} END"


BLOCKS = """, b0 AS (SELECT mint, us // 3600000000 AS block, quantile_cont(sol_amount, 0.8) AS cut FROM pairs GROUP BY ALL)
, b1 AS (SELECT mint, block, min(us) AS us, count(*) AS block_size, sum(sol_amount) AS total_volume, arg_min(sol_amount / token_amount, (us, row_index)) FILTER (sol_amount > 0 AND token_amount > 0) AS price,
    sum(CASE WHEN is_buy THEN 1 ELSE 0 END)::DOUBLE AS buys, sum(CASE WHEN is_sell THEN 1 ELSE 0 END)::DOUBLE AS sells, sum(CASE WHEN is_buy THEN sol_amount ELSE 0 END) AS bought, sum(CASE WHEN is_sell THEN sol_amount ELSE 0 END) AS sold,
    string_agg(CASE WHEN is_buy THEN 'B' ELSE 'S' END, '' ORDER BY us, row_index) AS sides, max(sol_amount) AS most, count(DISTINCT swapper)::DOUBLE AS traders,
    avg(CASE WHEN sol_amount >= cut THEN CASE WHEN is_buy THEN 1e0 ELSE 0e0 END END) AS large_buy_ratio
  FROM (SELECT *, us // 3600000000 AS block FROM pairs) JOIN b0 USING (mint, block) GROUP BY mint, block)
, blocks AS (SELECT mint, block, us, block_size, total_volume, price, (buys - sells) / block_size AS flow_imbalance, (bought - sold) / total_volume AS volume_imbalance, buys / block_size AS buy_ratio,
    CAST(sides LIKE '%BBB%' AS INTEGER) AS clustered_buys, CAST(sides LIKE '%SSS%' AS INTEGER) AS clustered_sells, CAST(sides LIKE '%BB' AS INTEGER) AS momentum_buys, CAST(sides LIKE '%SS' AS INTEGER) AS momentum_sells,
    most / total_volume AS size_concentration, traders / block_size AS trader_concentration, large_buy_ratio,
    CAST((buys - sells) / block_size > 0.3 AND sides LIKE '%BBB%' AS INTEGER) AS strong_buy_signal, CAST((buys - sells) / block_size < -0.3 AND sides LIKE '%SSS%' AS INTEGER) AS strong_sell_signal,
    CAST(sides LIKE '%BB' AS INTEGER) - CAST(sides LIKE '%SS' AS INTEGER) AS momentum_signal, abs((buys - sells) / block_size) AS imbalance_strength
  FROM b1 WHERE block_size >= 3 AND total_volume > 0 AND price IS NOT NULL)
"""
BLOCK_DOUBLES = ("total_volume", "price", "flow_imbalance", "volume_imbalance", "buy_ratio", "size_concentration", "trader_concentration", "large_buy_ratio", "imbalance_strength")

WIDTHS = range(5, 11)
MOVES = """, m0 AS (SELECT *, CASE WHEN is_buy THEN sol_amount ELSE -sol_amount END AS signed, count(*) OVER (PARTITION BY mint) AS n, row_number() OVER w - 1 AS place, lag(price) OVER w AS before
  FROM priced_pairs WINDOW w AS (PARTITION BY mint ORDER BY us, row_index))
, m AS (SELECT *, price - before AS change, price / before - 1 AS r FROM m0)
"""


def toxicity_sql() -> str:
    """Frames of each width; the coin's own is picked."""
    frames = ", ".join(f"w{k} AS (PARTITION BY mint ORDER BY place ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in WIDTHS)
    corr = " ".join(f"WHEN {k} THEN corr(signed, change) OVER w{k}" for k in WIDTHS)
    lam = " ".join(f"WHEN {k} THEN stddev_samp(change) OVER w{k} / nullif(avg(abs(signed)) OVER w{k}, 0)" for k in WIDTHS)
    rows = f""", f0 AS (SELECT *, least(10, n // 4) AS width FROM m WHERE n >= 20)
, f1 AS (SELECT *, CASE WHEN place >= width THEN CASE width {corr} END END AS c, CASE WHEN place >= width THEN CASE width {lam} END END AS impact FROM f0 WINDOW {frames})
, f AS (SELECT * EXCLUDE (c), {finite("c")} AS c FROM f1)
"""
    return MOVES + rows + """, tox AS (SELECT mint, count(*) AS total_transactions, (max(us) - min(us)) / 3.6e9 AS time_span_hours, avg(price) AS avg_price, stddev_samp(r) AS price_volatility, (max(price) - min(price)) / avg(price) AS price_range_pct,
  sum(sol_amount) AS total_volume, avg(sol_amount) AS avg_trade_size, max(sol_amount) / sum(sol_amount) AS volume_concentration, sum(signed) AS net_flow, sum(signed) / sum(sol_amount) AS flow_imbalance,
  avg(CASE WHEN is_buy THEN 1e0 ELSE 0e0 END) AS buy_ratio, avg(c) AS avg_flow_price_corr, stddev_samp(c) AS flow_price_corr_volatility, avg(impact) AS kyle_lambda_proxy, corr(price, sol_amount) AS price_volume_corr,
  corr(r, sol_amount) AS return_volume_corr, abs(avg(c)) AS informed_trading_proxy FROM f GROUP BY mint)
"""


TOX_DOUBLES = ("time_span_hours", "avg_price", "price_volatility", "price_range_pct", "total_volume", "avg_trade_size", "volume_concentration", "net_flow", "flow_imbalance", "buy_ratio", "avg_flow_price_corr",
               "flow_price_corr_volatility", "kyle_lambda_proxy", "price_volume_corr", "return_volume_corr", "informed_trading_proxy")

EVENTS = MOVES + """, e AS (SELECT mint, us, row_index, price, r AS price_impact, round(sum(sol_amount) OVER w / 20, 9) AS volume_intensity,
    CASE WHEN count(r) OVER w = 20 THEN round(stddev_samp(r) OVER w, 9) END AS rolling_vol FROM m WINDOW w AS (PARTITION BY mint ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
, ev AS (SELECT *, quantile_cont(abs(price_impact), 0.9) OVER c AS p90, quantile_cont(volume_intensity, 0.9) OVER c AS v90, quantile_cont(volume_intensity, 0.5) OVER c AS v50, quantile_cont(volume_intensity, 0.75) OVER c AS v75,
    quantile_cont(rolling_vol, 0.33) OVER c AS low, quantile_cont(rolling_vol, 0.67) OVER c AS high FROM e WHERE price_impact IS NOT NULL WINDOW c AS (PARTITION BY mint))
, regimes AS (SELECT *, CASE WHEN rolling_vol <= low THEN 'low' WHEN rolling_vol >= high THEN 'high' ELSE 'medium' END AS regime FROM ev WHERE rolling_vol IS NOT NULL)
"""
#: Coins with limits of their own, and groups of coins, as the tables of a user.
LIMITS = (("coin_view", 0.05, 2.0, True), ("coin_click", 0.03, 1.5, True), ("coin_purchase", 0.1, 3.0, False))
GROUPS = (("coin_view", "magnitude"), ("coin_click", "direction"))
TURN = "CASE WHEN price_impact > 0 THEN 'SELL' ELSE 'BUY' END"


def values(rows: tuple) -> str:
    return ", ".join(str(row).replace("True", "true").replace("False", "false") for row in rows)


VARIANTS = EVENTS + f""", plain AS (SELECT *, {TURN} AS side FROM ev WHERE abs(price_impact) > 0.05 AND volume_intensity > 2.0)
, limits(mint, pl, vl, ts) AS (VALUES {values(LIMITS)}), grps(mint, grp) AS (VALUES {values(GROUPS)})
, variants AS (
  SELECT 'all' AS variant, mint, us, row_index, side FROM plain UNION ALL SELECT 'buy_only', mint, us, row_index, side FROM plain WHERE side = 'BUY'
  UNION ALL SELECT 'per_coin', mint, us, row_index, {TURN} FROM ev JOIN limits USING (mint) WHERE abs(price_impact) > pl AND volume_intensity > vl AND (price_impact <= 0 OR ts)
  UNION ALL SELECT 'adaptive', mint, us, row_index, {TURN} FROM ev WHERE abs(price_impact) > p90 AND volume_intensity > v90
  UNION ALL SELECT 'volume_weighted', mint, us, row_index, {TURN} FROM ev WHERE abs(price_impact) > 0.04 AND volume_intensity >= v75
  UNION ALL SELECT 'regime_aware', mint, us, row_index, {TURN} FROM regimes WHERE abs(price_impact) > CASE regime WHEN 'low' THEN 0.03 WHEN 'high' THEN 0.08 ELSE 0.05 END AND volume_intensity > CASE regime WHEN 'low' THEN 1.5 WHEN 'high' THEN 3.0 ELSE 2.0 END
  UNION ALL SELECT 'coin_group', mint, us, row_index, CASE WHEN price_impact < 0 THEN 'BUY' ELSE 'SELL' END FROM ev LEFT JOIN grps USING (mint)
    WHERE CASE grp WHEN 'magnitude' THEN abs(price_impact) > 0.04 AND volume_intensity > v75 WHEN 'direction' THEN abs(price_impact) > 0.03 AND volume_intensity > v50 ELSE price_impact < -0.05 END)
"""
REVERSION = """, p0 AS (SELECT *, sol_amount / token_amount AS price, row_number() OVER (PARTITION BY mint ORDER BY us, row_index) - 1 AS place FROM pairs)
, p1 AS (SELECT *, avg(price) OVER w AS mean, round(sum(sol_amount) OVER w / 20, 9) AS vi, avg(CASE WHEN is_buy THEN 1e0 ELSE 0e0 END) OVER f AS flow
  FROM p0 WINDOW w AS (PARTITION BY mint ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY mint ORDER BY place ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))
, p2 AS (SELECT *, round((price - mean) / mean, 9) AS dev, quantile_cont(vi, 0.75) OVER (PARTITION BY mint) AS cut FROM p1)
, p3 AS (SELECT *, CASE WHEN abs(dev) >= 0.05 THEN CASE WHEN dev > 0 THEN 'SELL' ELSE 'BUY' END END AS first, CASE WHEN flow >= 0.7 THEN 'SELL' WHEN flow <= 1 - 0.7e0 THEN 'BUY' END AS pressed FROM p2 WHERE place >= 50)
, p4 AS (SELECT *, coalesce(pressed = coalesce(first, pressed), false) AS agrees FROM p3)
, p5 AS (SELECT mint, us, row_index, price, coalesce(first, pressed) AS side, CASE WHEN first IS NOT NULL THEN abs(dev) * 10 ELSE 0 END + CASE WHEN agrees THEN 1 ELSE 0 END + CASE WHEN vi >= cut THEN 0.5e0 ELSE 0 END + CASE WHEN sol_amount >= 10 THEN 0.5e0 ELSE 0 END AS strength,
    concat_ws(',', CASE WHEN first IS NOT NULL THEN 'price' END, CASE WHEN agrees THEN 'flow' END, CASE WHEN vi >= cut THEN 'volume' END, CASE WHEN sol_amount >= 10 THEN 'size' END) AS reasons FROM p4)
, rev AS (SELECT * FROM p5 WHERE side IS NOT NULL AND strength >= 1)
"""


def register(add, r, by_bars) -> None:
    doubles = lambda names: ", ".join(r(n, n) for n in names)
    kept = ", ".join(f"b.{n}" if n not in BLOCK_DOUBLES else r(f"b.{n}", n) for n in ("mint", "block", "us", "block_size", *BLOCK_DOUBLES[:2], *flow.SIGNALS))
    add("block_signals", blocks, TRADES_SQL + BLOCKS + f"SELECT {kept} FROM blocks b")
    tox = lambda spark, d: flow.toxicity_classes(flow.flow_toxicity(priced(spark, d)))
    add("flow_toxicity", tox, TRADES_SQL + toxicity_sql() + f""", q AS (SELECT quantile_cont(avg_flow_price_corr, 0.25) AS q25, quantile_cont(avg_flow_price_corr, 0.75) AS q75 FROM tox)
SELECT mint, total_transactions, {doubles(TOX_DOUBLES)}, CASE WHEN avg_flow_price_corr > q75 THEN 'High Toxicity' WHEN avg_flow_price_corr > q25 THEN 'Medium Toxicity' WHEN avg_flow_price_corr IS NOT NULL THEN 'Low Toxicity' ELSE 'Unknown' END AS toxicity_category FROM tox, q""")  # fmt: skip
    add("integrate_flow", lambda spark, d: flow.integrate_flow(blocks(spark, d).select("mint", "block", "flow_imbalance", "block_size"), flow.flow_toxicity(priced(spark, d)), ["avg_flow_price_corr", "kyle_lambda_proxy"]),
        TRADES_SQL + BLOCKS + toxicity_sql() + f"SELECT mint, block, {r('b.flow_imbalance', 'flow_imbalance')}, block_size, {r('avg_flow_price_corr', 'avg_flow_price_corr')}, {r('kyle_lambda_proxy', 'kyle_lambda_proxy')} FROM blocks b JOIN tox USING (mint)")
    add("lead_lag", lambda spark, d: flow.lead_lag(priced(spark, d)), TRADES_SQL + MOVES + f""", l AS (SELECT *, lag(signed) OVER w AS flow0, lag(change) OVER w AS change0 FROM m WHERE n >= 100 WINDOW w AS (PARTITION BY mint ORDER BY place))
, g AS (SELECT mint, count(*) - 1 AS data_points, corr(flow0, change) FILTER (place >= 2) AS a, corr(change0, signed) AS b, corr(abs(change0), sol_amount) AS c FROM l GROUP BY mint)
SELECT mint, data_points, {r(finite("a"), "flow_predicts_price")}, {r(finite("b"), "price_predicts_flow")}, {r(finite("c"), "momentum_correlation")}, CASE WHEN abs(a) > abs(b) * 1.5 THEN 'Information-driven' WHEN abs(b) > abs(a) * 1.5 THEN 'FOMO-driven' ELSE 'Mixed' END AS interpretation FROM g""")  # fmt: skip
    long = " UNION ALL ".join(f"SELECT '{s}' AS signal, {str(s in flow.FLAGS).lower()} AS flag, horizon, ret, CAST({s} AS DOUBLE) AS value FROM rets" for s in flow.SIGNALS)
    add("signal_performance", lambda spark, d: flow.signal_performance(flow.with_forward_returns(blocks(spark, d), HOURS, DAY)), TRADES_SQL + BLOCKS + f""", hz AS (SELECT CAST(unnest([{", ".join(map(str, HOURS))}]) AS INTEGER) AS horizon)
, asks AS (SELECT *, us + CAST(horizon AS BIGINT) * 1000000 AS at FROM blocks, hz)
, rets AS (SELECT a.*, q.price / a.price - 1 AS ret FROM asks a ASOF JOIN (SELECT mint, us, price FROM blocks) q ON a.mint = q.mint AND a.at <= q.us)
, long AS ({long})
, cut AS (SELECT *, quantile_cont(value, 0.25) OVER w AS low, quantile_cont(value, 0.75) OVER w AS high FROM long WINDOW w AS (PARTITION BY signal, horizon))
, sided AS (SELECT *, CASE WHEN flag THEN value = 1 ELSE value >= high END AS buy, CASE WHEN flag THEN value = 0 ELSE value <= low END AS sell FROM cut)
, x AS (SELECT *, CASE WHEN buy THEN ret END AS up, CASE WHEN sell THEN ret END AS down, CASE WHEN NOT (buy OR sell) THEN ret END AS rest FROM sided)
SELECT signal, horizon, count(*) AS total_observations, count(up) AS buy_signals, {r("coalesce(count(*) FILTER (up > 0) * 1e0 / nullif(count(up), 0), 0)", "buy_hit_rate")}, {r("coalesce(avg(up), 0)", "buy_avg_return")}, {r("coalesce(stddev_samp(up), 0)", "buy_return_std")},
  count(down) AS sell_signals, {r("coalesce(count(*) FILTER (down < 0) * 1e0 / nullif(count(down), 0), 0)", "sell_hit_rate")}, {r("coalesce(avg(down), 0)", "sell_avg_return")}, {r("coalesce(stddev_samp(down), 0)", "sell_return_std")},
  count(rest) AS neutral_signals, {r("coalesce(avg(rest), 0)", "neutral_avg_return")}, {r("coalesce(avg(up) / nullif(stddev_samp(up), 0), 0)", "buy_sharpe")}, {r("coalesce(abs(avg(down)) / nullif(stddev_samp(down), 0), 0)", "sell_sharpe")}
FROM x GROUP BY signal, horizon""")  # fmt: skip

    events = lambda spark, d: impact.impact_series(priced(spark, d))
    add("impact_series", events, TRADES_SQL + EVENTS + f"SELECT mint, us, row_index, {doubles(('price', 'price_impact', 'volume_intensity', 'rolling_vol'))} FROM ev")
    add("vol_regime", lambda spark, d: impact.vol_regime(events(spark, d)).select("mint", "us", "row_index", "rolling_vol", "regime"), TRADES_SQL + EVENTS + f"SELECT mint, us, row_index, {r('rolling_vol', 'rolling_vol')}, regime FROM regimes")

    def variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        rows = events(spark, sf_dir)
        limits = spark.createDataFrame(list(LIMITS), "mint string, price_limit double, volume_limit double, trade_sell boolean")
        return impact.signal_variants(rows, limits, spark.createDataFrame(list(GROUPS), "mint string, grp string")), rows

    add("signal_variants", lambda spark, d: variants(spark, d)[0], TRADES_SQL + VARIANTS + "SELECT * FROM variants")
    stats = f"""count(*) AS num_trades, {r("avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END)", "win_rate")}, {r("avg(ret)", "avg_return")}, {r("coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0)", "sharpe_ratio")}, {r("max(ret)", "max_return")}, {r("min(ret)", "min_return")}"""
    holds = (3600, 14_400, 43_200)
    add("evaluate_hold", lambda spark, d: impact.evaluate_hold(*variants(spark, d), holds), TRADES_SQL + VARIANTS + f""", run AS (SELECT mint, us, sum(price_impact) OVER w AS t, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY mint ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, cum AS (SELECT DISTINCT ON (mint, us) * FROM run)
, asked AS (SELECT v.*, hold, us + CAST(hold AS BIGINT) * 1000000 AS at FROM variants v, (SELECT CAST(unnest([{", ".join(map(str, holds))}]) AS INTEGER) AS hold))
, found AS (SELECT a.*, e.t AS t1, e.n AS n1, s.t AS t0, s.n AS n0 FROM asked a ASOF JOIN cum e ON a.mint = e.mint AND a.at >= e.us JOIN cum s ON a.mint = s.mint AND a.us = s.us)
, res AS (SELECT variant, hold, CASE WHEN side = 'BUY' THEN round(t1 - t0, 9) ELSE -round(t1 - t0, 9) END AS ret FROM found WHERE n1 > n0)
SELECT variant, hold, {stats} FROM res GROUP BY variant, hold""")  # fmt: skip
    rev = lambda spark, d: impact.reversion_signals(pairs(spark, d))
    add("reversion_signals", rev, TRADES_SQL + REVERSION + f"SELECT mint, us, row_index, {r('price', 'price')}, side, {r('strength', 'strength')}, reasons FROM rev")
    add("evaluate_exit_price", lambda spark, d: impact.evaluate_exit_price(rev(spark, d), priced(spark, d).select("mint", "us", "row_index", "price"), holds), TRADES_SQL + REVERSION + f""", quotes AS (SELECT mint, us, arg_min(price, row_index) AS price FROM priced_pairs GROUP BY ALL)
, asked AS (SELECT v.*, hold, us + CAST(hold AS BIGINT) * 1000000 AS at FROM rev v, (SELECT CAST(unnest([{", ".join(map(str, holds))}]) AS INTEGER) AS hold))
, res AS (SELECT side, hold, round(CASE WHEN side = 'BUY' THEN q.price / a.price - 1 ELSE -(q.price / a.price - 1) END, 9) AS ret FROM asked a ASOF JOIN quotes q ON a.mint = q.mint AND a.at <= q.us)
SELECT side, hold, {stats} FROM res GROUP BY side, hold""")  # fmt: skip
    sized = ", z AS (SELECT *, round(abs(price_impact), 9) AS size FROM ev), zq AS (SELECT quantile_cont(size, 0.33) AS lo, quantile_cont(size, 0.67) AS hi FROM z)"
    add("impact_regimes", lambda spark, d: impact.impact_regimes(events(spark, d)), TRADES_SQL + EVENTS + sized + f"""SELECT CASE WHEN size <= lo THEN 'low' WHEN size <= hi THEN 'medium' ELSE 'high' END AS regime, count(*) AS n_events, {r("avg(volume_intensity)", "avg_volume")},
  {r("CASE WHEN count(*) > 100 THEN corr(price_impact, volume_intensity) END", "price_vol_corr")} FROM z, zq GROUP BY 1""")  # fmt: skip
    add("volume_sweep", lambda spark, d: impact.volume_sweep(events(spark, d)), TRADES_SQL + EVENTS + f""", s AS (SELECT CAST(unnest([50, 75, 90, 95]) AS INTEGER) AS percent), t AS (SELECT quantile_cont(volume_intensity, [0.5, 0.75, 0.9, 0.95]) AS q FROM ev)
, c AS (SELECT percent, q[list_position([50, 75, 90, 95], percent)] AS cut FROM s, t)
SELECT percent, {r("cut", "volume_cut")}, count(*) AS n, {r("avg(abs(price_impact))", "mean_impact")} FROM ev JOIN c ON volume_intensity > cut GROUP BY percent, cut""")  # fmt: skip

    by_bars("overreaction", lambda b: reversal.overreaction(b, 0.2), f""", o AS (SELECT *, min(r) OVER a AS low5, max(r) OVER a AS high5, lead(r) OVER w AS nxt,
    CASE WHEN count(r) OVER b = 5 THEN stddev_samp(r) OVER b END AS before, CASE WHEN count(r) OVER a = 5 THEN stddev_samp(r) OVER a END AS after
  FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY us), a AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), b AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT symbol, count(*) AS moves, count(CASE WHEN r > 0 AND low5 <= -0.1 OR r <= 0 AND high5 >= 0.1 THEN 1 END) AS turned, {r("avg(CASE WHEN r > 0 THEN -nxt ELSE nxt END)", "mean_back")}, {r("avg(after / nullif(before, 0))", "volatility_ratio")}
FROM o WHERE abs(r) > 0.2 GROUP BY symbol""")  # fmt: skip

    def quarters(bars: DataFrame) -> DataFrame:
        days = studies.daily_frame(bars)
        return reversal.quarterly_compare(days, ["intraday", "gap"], "intraday")

    by_bars("quarterly_compare", quarters, f""", d0 AS (SELECT symbol, us // {DAY} AS day, arg_min(open, us) AS open, arg_max(close, us) AS close FROM bars GROUP BY ALL)
, d AS (SELECT symbol, day, ln(1 + coalesce(close / nullif(open, 0) - 1, 0)) AS intraday, ln(1 + coalesce(open / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1, 0)) AS gap, date '1970-01-01' + CAST(day AS INTEGER) AS dt FROM d0)
, q AS (SELECT symbol, year(dt) AS y, quarter(dt) AS q, round(exp(sum(intraday) - arg_min(intraday, day)) - 1, 9) AS intraday, round(exp(sum(gap) - arg_min(gap, day)) - 1, 9) AS gap FROM d GROUP BY ALL)
SELECT symbol, strategy, count(*) AS quarters, {r("avg(CASE WHEN ret > base THEN 1e0 ELSE 0e0 END)", "better_share")}, {r("avg(ret)", "mean_return")} FROM (SELECT symbol, 'intraday' AS strategy, intraday AS ret, intraday AS base FROM q UNION ALL SELECT symbol, 'gap', gap, intraday FROM q) GROUP BY symbol, strategy""")  # fmt: skip
