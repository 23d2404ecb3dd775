"""Queries of bars' returns, sessions and days, with the SQL that gives the same rows. Bars are of an hour here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeframe.operators import profiles, returns, trades, windows

DAY, MINUTE = 86_400_000_000, 60_000_000
LAGS, WIDTH = (1, 5, 10), 12


def varied(x: str, y: str) -> str:
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN stddev_pop({x}) {both} > 0 AND stddev_pop({y}) {both} > 0 THEN corr({x}, {y}) END"


def register(add, r, by_bars, by_norm, features, window_sql) -> None:
    by_bars("return_set", returns.return_set, f""", x AS (SELECT *, lag(close) OVER w AS before, lag(us) OVER w AS earlier FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY us))
SELECT symbol, us, {r("close", "close")}, {r("r", "r")}, {r(f"CASE WHEN earlier // {DAY} = us // {DAY} THEN r END", "r_day")}, {r("CASE WHEN close > 0 AND before > 0 THEN ln(close / before) END", "log_r")},
  {r("CASE WHEN count(*) FILTER (r <= -1) OVER w > 0 THEN -1e0 ELSE exp(coalesce(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER w, 0)) - 1 END", "cum_return")} FROM x WINDOW w AS (PARTITION BY symbol ORDER BY us)""")  # fmt: skip
    by_bars("volume_fifths", lambda b: returns.quantile_bucket(b.select("symbol", "us", "volume"), ["symbol"], "volume", 5), f""", q AS (SELECT symbol, quantile_cont(volume, [0.2, 0.4, 0.6, 0.8]) AS q FROM bars GROUP BY symbol)
SELECT symbol, us, {r("volume", "volume")}, CAST(1 + len([c FOR c IN q IF c < volume]) AS INTEGER) AS bucket FROM bars JOIN q USING (symbol)""")  # fmt: skip
    minute = f"us // {MINUTE} % 1440"
    by_bars("sessions", lambda b: returns.sessions(b, 540, 1020, 60), f"""SELECT symbol, us, {minute} AS minute, dayname(make_timestamp(us)) AS day_name, CAST(quarter(make_timestamp(us)) AS INTEGER) AS quarter, CASE WHEN {minute} >= 540 AND {minute} < 1020 THEN 'regular' ELSE 'extended' END AS session,
  {minute} >= 540 AND {minute} < 600 AS first_part, {minute} >= 960 AND {minute} < 1020 AS last_part, {minute} >= 690 AND {minute} < 840 AS midday,
  {r("coalesce((us - min(us) OVER w) / nullif((max(us) OVER w - min(us) OVER w)::DOUBLE, 0), 0e0)", "lifecycle")} FROM bars WINDOW w AS (PARTITION BY symbol)""")  # fmt: skip
    by_bars("vwap_deviation", lambda b: returns.vwap_deviation(b.withColumn("vwap", F.col("volume") / F.col("transactions"))), f"SELECT symbol, us, {r('close - volume / transactions', 'deviation')}, {r('(close - volume / transactions) / nullif(volume / transactions, 0) * 100', 'deviation_pct')} FROM bars")
    names = {f"p{p * 100:g}".replace(".", "_"): p for p in returns.SHARES}
    by_bars("return_distribution", returns.return_distribution, f""", c AS (SELECT symbol, {", ".join(f"quantile_cont(r, {p}) AS {n}" for n, p in names.items())} FROM ret WHERE r IS NOT NULL GROUP BY symbol)
SELECT symbol, count(r) AS n, {r("avg(r)", "mean")}, {r("stddev_samp(r)", "std")}, {r("skewness(r)", "skew")}, {r("kurtosis(r)", "kurtosis")}, {", ".join(r(f"any_value({n})", n) for n in names)}, count(*) FILTER (r < p0_1 OR r > p99_9) AS extremes FROM ret JOIN c USING (symbol) WHERE r IS NOT NULL GROUP BY symbol""")  # fmt: skip
    by_bars("extreme_returns", returns.extreme_returns, f"SELECT symbol, us, {r('close', 'close')}, {r('r', 'r')}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC, us) AS INTEGER) AS place FROM ret WHERE r IS NOT NULL QUALIFY place <= 10")
    parts = []
    for name, width in (("hour", 180), ("half", 120)):
        on = f"{minute} >= 540 AND {minute} < {540 + width}"
        parts += [r(f"arg_max(close, us) FILTER ({on})", f"{name}_close"), r(f"max(close) FILTER ({on})", f"{name}_high"), r(f"min(close) FILTER ({on})", f"{name}_low"), r(f"sum(volume) FILTER ({on})", f"{name}_volume"), r(f"arg_max(close, us) FILTER ({on}) / nullif(arg_min(open, us) FILTER ({on}), 0) - 1", f"{name}_return")]
    by_bars("daily_detail", lambda b: returns.daily_detail(b, 540, 180, 120), f"SELECT symbol, us // {DAY} AS day, {r('arg_min(open, us)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('arg_max(close, us)', 'close')}, {r('sum(volume)', 'volume')}, {', '.join(parts)} FROM bars GROUP BY ALL")
    lagged = ", ".join(f"lag(r, {k}) OVER w AS r{k}" for k in LAGS)
    corrs = ", ".join(f"{varied('abs(r)', f'abs(r{k})')} AS abs_autocorr_{k}, {varied('r * r', f'(r{k} * r{k})')} AS square_autocorr_{k}" for k in LAGS)
    doubles = [f"{kind}_autocorr_{k}" for kind in ("abs", "square") for k in LAGS] + ["mean_vol", "std_vol", "least_vol", "most_vol", "p95_vol"]
    by_bars("volatility_table", lambda b: returns.volatility_table(b, WIDTH, LAGS), f""", l AS (SELECT symbol, us, r, {lagged}, CASE WHEN count(*) OVER f >= 2 THEN stddev_samp(r) OVER f END AS vol FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY us), f AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW))
, c AS (SELECT symbol, quantile_cont(vol, 0.95) AS cut FROM l GROUP BY symbol)
, g AS (SELECT symbol, count(*) AS n, {corrs}, avg(vol) AS mean_vol, stddev_samp(vol) AS std_vol, min(vol) AS least_vol, max(vol) AS most_vol, any_value(cut) AS p95_vol, count(*) FILTER (vol > cut) AS high_periods FROM l JOIN c USING (symbol) GROUP BY symbol)
SELECT symbol, n, {", ".join(r(d, d) for d in doubles)}, high_periods, {r("1.96e0 / sqrt(n)", "bound")}, CAST({" + ".join(f"CASE WHEN abs(square_autocorr_{k}) > 1.96e0 / sqrt(n) THEN 1 ELSE 0 END" for k in LAGS)} AS INTEGER) AS significant, {r("mean_vol * sqrt(252 * 6.5e0 * 60)", "annual_vol")} FROM g""")  # fmt: skip
    by_bars("volume_impact", returns.volume_impact, f""", s AS (SELECT *, (high - low) / nullif(close, 0) * 100 AS spread, abs(r) AS size FROM ret), n AS (SELECT *, lead(size) OVER w AS next_size, lead(spread) OVER w AS next_spread FROM s WINDOW w AS (PARTITION BY symbol ORDER BY us))
, c AS (SELECT symbol, quantile_cont(volume, [0.25, 0.5, 0.75]) AS q, avg(volume) AS m, stddev_samp(volume) AS sd, {varied("volume", "size")} AS a, {varied("volume", "next_size")} AS b, {varied("volume", "next_spread")} AS d FROM n GROUP BY symbol)
SELECT symbol, CAST(1 + len([c FOR c IN q IF c < volume]) AS INTEGER) AS bucket, count(*) AS n, {r("avg(size)", "mean_size")}, {r("avg(spread)", "mean_spread_pct")}, {r("(avg(volume) - any_value(m)) / any_value(sd)", "mean_volume_z")}, {r("any_value(a)", "volume_size_corr")}, {r("any_value(b)", "next_size_corr")}, {r("any_value(d)", "next_spread_corr")}
FROM n JOIN c USING (symbol) GROUP BY ALL""")  # fmt: skip
    by_bars("day_counts", returns.day_counts, f""", d AS (SELECT symbol, us // {DAY} AS day, count(*) AS n FROM bars GROUP BY ALL), m AS (SELECT *, avg(n) OVER a AS mean_n, stddev_samp(n) OVER a AS std_n, avg(n) OVER b AS local_mean, stddev_samp(n) OVER b AS local_std FROM d WINDOW a AS (PARTITION BY symbol), b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
SELECT symbol, day, n, {", ".join(r(c, c) for c in ("mean_n", "std_n", "local_mean", "local_std"))}, coalesce(n < mean_n - 2 * std_n, false) AS is_gap, coalesce(n < local_mean - 3 * local_std, false) AS is_local_gap FROM m""")  # fmt: skip
    by_bars("time_counts", returns.time_counts, f""", x AS (SELECT symbol, us, (us - lag(us) OVER (PARTITION BY symbol ORDER BY us)) // {MINUTE} AS step FROM bars)
SELECT symbol, 'weekday' AS kind, CAST(dayofweek(make_timestamp(us)) + 1 AS BIGINT) AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT symbol, 'hour', us // {60 * MINUTE} % 24, count(*) FROM x GROUP BY ALL UNION ALL SELECT symbol, 'interval', step, count(*) FROM x WHERE step IS NOT NULL GROUP BY ALL""")  # fmt: skip
    frame = "OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    by_bars("regime_gaps", returns.regime_gaps, f""", d0 AS (SELECT symbol, us // {DAY} AS day, arg_min(open, us) AS open, arg_max(close, us) AS close, sum(volume) AS volume FROM bars GROUP BY ALL)
, d AS (SELECT *, open / nullif(lag(close) OVER w, 0) - 1 AS gap, close / nullif(open, 0) - 1 AS held, coalesce(close > lag(close) OVER w, false) AS up FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY day))
, u AS (SELECT *, CASE WHEN count(*) {frame} >= 5 THEN sum(CASE WHEN up THEN volume ELSE 0e0 END) {frame} END AS a, CASE WHEN count(*) {frame} >= 5 THEN sum(CASE WHEN up THEN 0e0 ELSE volume END) {frame} END AS b FROM d)
, s AS (SELECT *, CASE WHEN b > 0 THEN a / b WHEN a > 0 THEN 'inf'::DOUBLE END AS ratio FROM u)
, t AS (SELECT *, ratio > 1 AS bullish, CASE WHEN ratio > 1 AND gap > 0.01 THEN 1 WHEN ratio <= 1 AND gap < -0.01 THEN -1 ELSE 0 END AS signal FROM s)
SELECT symbol, day, {r("gap", "gap")}, {r("CASE WHEN isfinite(ratio) THEN ratio END", "up_down_ratio")}, bullish, signal, {r("signal * held", "regime_gap_return")} FROM t""")  # fmt: skip
    net = "coalesce(sum(CASE WHEN is_sell THEN sol_amount END), 0e0) - coalesce(sum(CASE WHEN is_buy THEN sol_amount END), 0e0)"
    by_norm("marked_pnl", lambda n: returns.mark_groups(profiles.trader_total_pnl(trades.positions_in_order(n)).select("swapper", "total_pnl", "profitable_coins"), "total_pnl", F.col("profitable_coins") > 2, k=0.5, least=10.0), f""", held AS (SELECT swapper, mint, {net} AS net FROM norm GROUP BY swapper, mint)
, p AS (SELECT swapper, sum(net) AS pnl, count(*) FILTER (net > 0) AS profitable_coins FROM held GROUP BY swapper), q AS (SELECT quantile_cont(pnl, 0.25) AS a, quantile_cont(pnl, 0.75) AS b, quantile_cont(pnl, 0.99) AS c FROM p WHERE profitable_coins > 2)
SELECT swapper, profitable_coins, {r("CASE WHEN profitable_coins > 2 THEN greatest(least(pnl, b + 0.5 * (b - a)), a - 0.5 * (b - a)) ELSE greatest(c * 10, 10) END", "total_pnl")} FROM p, q""")  # fmt: skip
    three = [name for name, _ in windows.SPARSE.windows]
    shaped = (f"buy_ratio_{three[1]}", f"txn_flow_imbalance_{three[1]}", f"volume_imbalance_{three[2]}")
    made = {f"buy_ratio_{a}_vs_{b}": f"buy_ratio_{a} / (buy_ratio_{b} + 1e-10)" for a in three for b in three if a != b}
    for w in three:
        made |= {f"volume_per_txn_{w}": f"total_volume_{w} / (total_txns_{w} + 1e-10)", f"volume_per_trader_{w}": f"total_volume_{w} / (unique_traders_{w} + 1e-10)"}
    made["volume_acceleration"] = f"total_volume_{three[0]} * 4 / (total_volume_{three[2]} + 1e-10)"
    for c in shaped:
        made |= {f"{c}_squared": f"{c} * {c}", f"{c}_cbrt": f"sign({c}) * abs({c}) ** (1e0 / 3)"}
    # where a base is 0 the ratio is of the order of 1e10: compared as its logarithm
    plain = lambda c: F.when(F.abs(c) < 1e6, F.col(c)).otherwise(F.round(F.log10(F.abs(F.col(c))), 3)).alias(c)
    add("interaction_set", lambda spark, d: returns.interaction_set(features(spark, d), three, 4.0, shaped).select("coin_id", "sample_us", *(plain(c) for c in made)),
        f"SELECT coin_id, sample_us, {', '.join(r(f'CASE WHEN abs({e}) < 1e6 THEN {e} ELSE round(log10(abs({e})), 3) END', c) for c, e in made.items())} FROM ({window_sql(windows.SPARSE)})")
