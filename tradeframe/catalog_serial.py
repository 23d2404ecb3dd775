"""Queries of series against their own past, with the SQL that gives the same rows. Scales are wide, as the test tables are sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeframe.catalog_flow import pairs
from tradeframe.operators import bars, serial
from tradeframe.sources.tables import TRADES_SQL, table

HOUR = 3_600_000_000
BARS_SQL = f"""WITH bars AS (SELECT event_type AS symbol, epoch_us(ts) // {HOUR} * {HOUR} AS us, arg_min(value, (epoch_us(ts), event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (epoch_us(ts), event_id)) AS close, sum(value) AS volume, count(*) AS transactions FROM events GROUP BY ALL)
"""

TIMEFRAMES = (3600, 14_400, 86_400)
SCALES = tuple(720 * s for s in serial.SCALES)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars_of(table(spark, sf_dir, "events"))


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def varied(x: str, y: str) -> str:
    """The correlation of the rows that have both, null where either doesn't vary."""
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN stddev_pop({x}) {both} > 0 AND stddev_pop({y}) {both} > 0 THEN corr({x}, {y}) END"


W = "OVER (PARTITION BY symbol, seconds ORDER BY slot"
REVERSION = BARS_SQL + f""", c AS (SELECT symbol, s AS seconds, us // (s * 1000000::BIGINT) AS slot, arg_max(close, us) AS close FROM bars, (SELECT unnest({list(TIMEFRAMES)}) AS s) GROUP BY ALL)
, r0 AS (SELECT *, (close - lag(close) {W})) / nullif(lag(close) {W}), 0) AS r FROM c)
, l AS (SELECT *, {", ".join(f"lag(r, {k}) {W}) AS r{k}" for k in serial.LAGS)}, {", ".join(f"CASE WHEN count(r) {W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} THEN sum(r) {W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS s{k}" for k in serial.STEPS)} FROM r0)
, g AS (SELECT symbol, seconds, count(*) AS n, {", ".join(f"{varied('r', f'r{k}')} AS autocorr_{k}" for k in serial.LAGS)}, regr_slope(r, r1) AS beta, regr_intercept(r, r1) AS alpha,
    {", ".join(f"CASE WHEN count(*) >= {2 * k} THEN var_samp(s{k}) / nullif({k} * var_samp(r), 0) END AS vr_{k}" for k in serial.STEPS)} FROM l WHERE r IS NOT NULL GROUP BY symbol, seconds)
SELECT symbol, CAST(seconds AS BIGINT) AS seconds, n, {", ".join(r(f"autocorr_{k}", f"autocorr_{k}") for k in serial.LAGS)}, {r("beta", "ar1_beta")}, {r("alpha", "ar1_alpha")}, {r("CASE WHEN abs(beta) > 0 AND abs(beta) < 1 THEN -ln(2) / ln(abs(beta)) END", "half_life")},
  {", ".join(r(f"vr_{k}", f"variance_ratio_{k}") for k in serial.STEPS)} FROM g"""

NATURAL = TRADES_SQL + f""", slots AS (SELECT mint, s AS scale_s, us // (s * 1000000::BIGINT) AS slot, sum(sol_amount) AS volume, count(*)::DOUBLE AS n, count(*) FILTER (is_buy) / count(*) AS buy FROM pairs, (SELECT unnest({list(SCALES)}) AS s) GROUP BY ALL)
, l AS (SELECT *, lag(volume) OVER w AS v1, lag(n) OVER w AS n1, lag(buy) OVER w AS b1 FROM slots WINDOW w AS (PARTITION BY mint, scale_s ORDER BY slot))
, g AS (SELECT mint, scale_s, count(*) AS slots, {varied("volume", "v1")} AS va, {varied("n", "n1")} AS na, {varied("buy", "b1")} AS ba, coalesce(avg(volume) / nullif(stddev_samp(volume), 0), 0) AS vs, coalesce(avg(n) / nullif(stddev_samp(n), 0), 0) AS ns FROM l GROUP BY mint, scale_s HAVING count(*) >= 10)
, scales AS (SELECT *, (va + na + ba) / 3 AS aa, row_number() OVER (PARTITION BY mint ORDER BY (va + na + ba) / 3 DESC NULLS LAST, scale_s) AS place FROM g)
"""
GAPS = """, gaps AS (SELECT mint, (us - lag(us) OVER (PARTITION BY mint ORDER BY us, row_index)) / 1e6 AS gap FROM pairs)
, q AS (SELECT mint, greatest(min(gap) * 3, 2) AS ultra_short, greatest(quantile_cont(gap, 0.5) * 10, 30) AS short, greatest(quantile_cont(gap, 0.75) * 5, 120) AS medium, greatest(quantile_cont(gap, 0.9) * 2, 300) AS long FROM gaps WHERE gap IS NOT NULL GROUP BY mint)
, m AS (SELECT q.*, scale_s::DOUBLE AS optimal_autocorr FROM q LEFT JOIN scales ON scales.mint = q.mint AND place = 1 AND aa IS NOT NULL)
"""
NAMES = ("ultra_short", "short", "medium", "long", "optimal_autocorr")


def windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    found = serial.recommended_windows(p, serial.natural_scales(p, SCALES))
    return found.selectExpr("mint", *NAMES, "size(windows) AS n_windows", "windows[0] AS first_window", "element_at(windows, -1) AS last_window")


RANKED = """, f AS (SELECT symbol, us, volume, list(volume) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS past FROM bars)
"""

#: name: query and SQL.
ALL = {
    "mean_reversion_by_scale": (lambda spark, d: serial.mean_reversion_by_scale(hourly(spark, d), TIMEFRAMES), REVERSION),
    "natural_scales": (
        lambda spark, d: serial.natural_scales(pairs(spark, d), SCALES),
        NATURAL + f"SELECT mint, CAST(scale_s AS BIGINT) AS scale_s, slots, {r('va', 'volume_autocorr')}, {r('na', 'txn_autocorr')}, {r('ba', 'buy_autocorr')}, {r('aa', 'avg_autocorr')}, {r('vs', 'volume_snr')}, {r('ns', 'txn_snr')}, CAST(place AS INTEGER) AS place FROM scales",
    ),
    "recommended_windows": (
        windows_of,
        NATURAL + GAPS + f", w AS (SELECT *, list_sort(list_distinct([x FOR x IN [{', '.join(NAMES)}] IF x IS NOT NULL])) AS windows FROM m) SELECT mint, {', '.join(r(n, n) for n in NAMES)}, CAST(len(windows) AS INTEGER) AS n_windows, {r('windows[1]', 'first_window')}, {r('windows[len(windows)]', 'last_window')} FROM w",
    ),
    "rolling_percent_rank": (
        lambda spark, d: serial.rolling_percent_rank(hourly(spark, d).select("symbol", "us", "volume"), "symbol", "us", "volume", 50),
        BARS_SQL + RANKED + f"SELECT symbol, us, {r('volume', 'volume')}, {r('CASE WHEN len(past) = 50 THEN (len([x FOR x IN past IF x < volume]) + (len([x FOR x IN past IF x = volume]) + 1) / 2) * 2 END', 'pct_rank')} FROM f",
    ),
}
