"""Queries of the wide feature sets, with the SQL that gives the same rows: samples joined with their coin's trades by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.catalog_flow import pairs
from tradeframe.operators import samples, signals, windows
from tradeframe.operators.windows import SECOND, SPARSE
from tradeframe.sources.tables import TRADES_SQL

#: Wide enough for the sparse test tables.
BACK, AHEAD = (3600, 7200, 36_000), (7200, 36_000)


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def grid_sql(cfg: windows.GridConfig) -> str:
    step = cfg.step * SECOND
    return TRADES_SQL + f""", spans AS (SELECT mint, min(us) + {cfg.buffer * SECOND} AS anchor, max(us) - {cfg.forward * SECOND} AS last FROM pairs GROUP BY mint HAVING count(*) >= {cfg.least_trades})
, grid AS (SELECT mint, anchor + {step} * unnest(range(0, (last - anchor) // {step} + 1)) AS sample_us FROM spans WHERE anchor < last)
"""


def near_sql(seconds: tuple[int, ...], ahead: bool = False, source: str = "pairs") -> str:
    sizes = f", sizes AS (SELECT unnest([{', '.join(map(str, seconds))}]) AS window_s)\n"
    width = f"window_s * {SECOND}::BIGINT"
    on = f"us >= sample_us AND us < sample_us + {width}" if ahead else f"us < sample_us AND us >= sample_us - {width}"
    return sizes + f", near AS (SELECT g.mint AS coin_id, sample_us, window_s, p.* EXCLUDE (mint) FROM grid g, sizes JOIN {source} p ON p.mint = g.mint AND {on})\n"


OF = {"small": "sol_amount > 0 AND sol_amount < 1", "medium": "sol_amount >= 1 AND sol_amount < 10", "big": "sol_amount >= 10 AND sol_amount < 100", "whale": "sol_amount >= 100"}


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) * 1e0 / nullif({b}, 0), 0e0)"


def extended_sql() -> str:
    total = lambda on: f"coalesce(sum(sol_amount) FILTER ({on}), 0e0)"
    out = {
        "total_volume": "v", "avg_transaction_size": "v / n", "median_transaction_size": "p50", "volume_std": "std", "volume_skew": "CASE WHEN std > 0 AND n > 2 THEN skew END", "volume_kurtosis": "CASE WHEN std > 0 AND n > 3 THEN kurt END",
        "volume_intensity": "v / window_s", "transaction_intensity": "n * 1e0 / window_s", "volume_concentration_top5": ratio("list_sum(amounts[1:5])", "v"), "volume_concentration_top10": ratio("list_sum(amounts[1:10])", "v"),
        "transactions_per_trader": "n * 1e0 / u", "trader_intensity": "u * 1e0 / window_s", "single_txn_trader_ratio": "singles * 1e0 / u", "volume_trader_concentration": ratio("list_sum(held[1:3])", "v"), "median_txns_per_trader": "median_n", "median_volume_per_trader": "median_held", "max_volume_per_trader": "held[1]",
        "buy_volume": "bv", "sell_volume": "sv", "buy_ratio": "b * 1e0 / n", "buy_volume_ratio": ratio("bv", "v"), "order_flow_imbalance": ratio("bv - sv", "v"), "transaction_flow_imbalance": "(b - s) * 1e0 / n",
        "avg_buy_size": ratio("bv", "b"), "avg_sell_size": ratio("sv", "s"), "buy_sell_size_ratio": ratio(ratio("bv", "b"), ratio("sv", "s")),
        "large_order_ratio": "large * 1e0 / n", "large_order_buy_ratio": "large_buys * 1e0 / large",
    } | {f"volume_p{p}": f"p{p}" for p in samples.PERCENTILES}
    whole = {"total_transactions": "n", "unique_traders": "u", "max_txns_per_trader": "max_n", "single_txn_traders": "singles", "high_freq_traders": "often", "buy_count": "b", "sell_count": "s", "large_order_count": "large", "large_buy_count": "large_buys", "large_sell_count": "large - large_buys"}
    parts, traders = [], []
    for c, on in OF.items():
        out |= {f"volume_{c}": f"volume_{c}", f"volume_ratio_{c}": ratio(f"volume_{c}", "v"), f"trader_ratio_{c}": f"traders_{c} * 1e0 / u", f"buy_ratio_{c}": ratio(f"buys_{c}", f"count_{c}"), f"buy_volume_ratio_{c}": ratio(f"bought_{c}", f"volume_{c}")}
        whole |= {f"count_{c}": f"count_{c}", f"unique_traders_{c}": f"traders_{c}"}
        parts += [f"{total(on)} AS volume_{c}", f"count(*) FILTER ({on}) AS count_{c}", f"count(*) FILTER ({on} AND is_buy) AS buys_{c}", f"{total(on + ' AND is_buy')} AS bought_{c}"]
        traders += [f"count(DISTINCT CASE WHEN {on} THEN swapper END) AS traders_{c}"]
    points = ", ".join(f"quantile_cont(sol_amount, {p / 100}) AS p{p}" for p in (*samples.PERCENTILES, 50))
    key = "coin_id, sample_us, window_s"
    return grid_sql(SPARSE) + near_sql(BACK) + f""", w AS (SELECT {key}, count(*) AS n, sum(sol_amount) AS v, stddev_samp(sol_amount) AS std, CASE WHEN count(*) > 2 AND stddev_samp(sol_amount) > 0 THEN skewness(sol_amount) END AS skew, CASE WHEN count(*) > 3 AND stddev_samp(sol_amount) > 0 THEN kurtosis(sol_amount) END AS kurt,
    {points}, list(sol_amount ORDER BY sol_amount DESC) AS amounts, count(DISTINCT swapper) AS u, count(*) FILTER (is_buy) AS b, count(*) FILTER (is_sell) AS s, {total("is_buy")} AS bv, {total("is_sell")} AS sv, {", ".join(parts + traders)} FROM near GROUP BY ALL)
, t0 AS (SELECT {key}, swapper, count(*) AS n, sum(sol_amount) AS held FROM near GROUP BY ALL)
, t AS (SELECT {key}, max(n) AS max_n, median(n) AS median_n, count(*) FILTER (n = 1) AS singles, count(*) FILTER (n >= 5) AS often, list(held ORDER BY held DESC) AS held, median(held) AS median_held FROM t0 GROUP BY ALL)
, l AS (SELECT {key}, count(*) AS large, count(*) FILTER (is_buy) AS large_buys FROM near JOIN w USING ({key}) WHERE sol_amount >= p90 GROUP BY ALL)
SELECT {key}, {", ".join(r(e, c) for c, e in out.items())}, {", ".join(f"{e} AS {c}" for c, e in whole.items())} FROM w JOIN t USING ({key}) JOIN l USING ({key})"""


def outcomes_sql() -> str:
    v, b, s = "sum(sol_amount)", "coalesce(sum(sol_amount) FILTER (is_buy), 0e0)", "coalesce(sum(sol_amount) FILTER (is_sell), 0e0)"
    out = {
        "forward_total_volume": v, "forward_buy_ratio": "count(*) FILTER (is_buy) * 1e0 / count(*)", "forward_avg_transaction_size": f"{v} / count(*)", "forward_volume_intensity": f"{v} / window_s", "forward_buy_volume": b,
        "forward_sell_volume": s, "forward_net_flow": f"{b} - {s}", "profitability_score": ratio(f"{b} - {s}", v), "volume_growth_score": f"{v} / window_s", "trader_growth": "count(DISTINCT swapper) * 1e0 / window_s",
    }
    return grid_sql(SPARSE) + near_sql(AHEAD, ahead=True) + f"""SELECT coin_id, sample_us, window_s, {", ".join(r(e, c) for c, e in out.items())}, count(*) AS forward_transaction_count, count(DISTINCT swapper) AS forward_unique_traders,
  {b} - {s} > 0 AS is_profitable_period FROM near GROUP BY coin_id, sample_us, window_s"""


def regimes_sql() -> str:
    b, s = "coalesce(sum(sol_amount) FILTER (is_buy), 0e0)", "coalesce(sum(sol_amount) FILTER (is_sell), 0e0)"
    u, n, v = "count(DISTINCT swapper)", "count(*)", "sum(sol_amount)"
    out = {
        "total_volume": v, "total_txns": f"{n} * 1e0", "unique_traders": f"{u} * 1e0", "avg_txn_size": f"{v} / ({n} + 1e-10)", "volume_per_trader": f"{v} / ({u} + 1e-10)", "buy_ratio": f"{b} / ({v} + 1e-10)", "buy_txn_ratio": f"count(*) FILTER (is_buy) / ({n} + 1e-10)",
        "volume_imbalance": f"({b} - {s}) / ({v} + 1e-10)", "txn_imbalance": f"(count(*) FILTER (is_buy) - count(*) FILTER (is_sell)) / ({n} + 1e-10)", "volume_concentration": f"CASE WHEN {v} > 0 THEN stddev_samp(sol_amount) / (avg(sol_amount) + 1e-10) ELSE 0e0 END",
        **{f"{c}_ratio": f"count(*) FILTER ({on}) * 1e0 / {n}" for c, on in OF.items()},
        "avg_time_between_txns": f"CASE WHEN {n} > 1 THEN avg(gap) ELSE 0e0 END", "txn_frequency_volatility": f"CASE WHEN {n} > 1 THEN stddev_samp(gap) ELSE 0e0 END",
    }
    names = {seconds: name for name, seconds in SPARSE.windows}
    columns = ", ".join(r(f"CASE WHEN count(*) FILTER (window_s = {s}) = 0 THEN 0e0 ELSE any_value({f}) FILTER (window_s = {s}) END", f"{f}_{name}") for s, name in names.items() for f in out)
    # gaps within the window alone: the first trade of a window has none
    gaps = ", gapped AS (SELECT *, (us - lag(us) OVER (PARTITION BY coin_id, sample_us, window_s ORDER BY us, row_index)) / 1e6 AS gap FROM near)\n"
    return grid_sql(SPARSE) + near_sql(tuple(names)) + gaps + f""", w AS (SELECT coin_id, sample_us, window_s, {", ".join(f"{e} AS {c}" for c, e in out.items())} FROM gapped GROUP BY ALL)
SELECT g.mint AS coin_id, g.sample_us, {columns} FROM grid g LEFT JOIN w ON w.coin_id = g.mint AND w.sample_us = g.sample_us GROUP BY ALL"""


#: What is screened, against what; and groups of features by what their names hold.
SCREENED = ("total_volume", "total_transactions", "median_transaction_size", "volume_std", "volume_concentration_top5", "unique_traders", "max_txns_per_trader", "single_txn_traders", "buy_ratio", "order_flow_imbalance", "large_order_ratio", "count_whale")
TARGETS = ("profitable", "profitability_score")
GROUPS = {"volume": ("total_volume", "volume_std"), "trader": ("unique_traders", "txn"), "order_flow": ("buy_ratio", "order_flow_imbalance"), "concentration": ("concentration", "whale"), "none": ()}


def signal_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a window before each sample beside outcomes of one after it; doubles to six places, so that ties are ties."""
    p = pairs(spark, sf_dir)
    features = samples.window_features_ext(p, SPARSE, BACK[1:2]).drop("window_s")
    outcomes = samples.forward_outcomes(p, SPARSE, AHEAD[1:]).drop("window_s").withColumn("profitable", F.col("is_profitable_period").cast("int"))
    rows = features.join(outcomes.select("coin_id", "sample_us", *TARGETS), ["coin_id", "sample_us"])
    return rows.select("coin_id", *(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in rows.select(*SCREENED, *TARGETS).dtypes))


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rank_screen(signal_dataset(spark, sf_dir), SCREENED, TARGETS)


def screened_sql() -> str:
    """The critical t of five per cent by its expansion about the normal one."""
    features, outcomes = extended_sql().split(", sizes AS", 1)[1], outcomes_sql().split(", sizes AS", 1)[1]
    data = grid_sql(SPARSE) + f""", features AS (WITH sizes AS{features}), outcomes AS (WITH sizes AS{outcomes})
, data AS (SELECT f.*, profitability_score, CAST(is_profitable_period AS INTEGER) AS profitable FROM features f JOIN outcomes o ON o.coin_id = f.coin_id AND o.sample_us = f.sample_us AND f.window_s = {BACK[1]} AND o.window_s = {AHEAD[1]})
"""
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS target, {f}::DOUBLE AS x, {t}::DOUBLE AS y FROM data" for f in SCREENED for t in TARGETS)
    z = 1.959963984540054
    crit = f"{z} + {(z**3 + z) / 4} / (n - 2) + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / (n - 2) ** 2 + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / (n - 2) ** 3"
    return data + f""", long AS ({long})
, placed AS (SELECT *, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / 2e0 AS ry FROM long WHERE x IS NOT NULL AND y IS NOT NULL)
, c0 AS (SELECT feature, target, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS pearson, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman FROM placed GROUP BY ALL)
, c AS (SELECT *, pearson * sqrt(n - 2) / nullif(sqrt(1 - pearson * pearson), 0) AS t, (abs(pearson) + abs(spearman)) / 2 AS mean_size FROM c0)
, tested AS (SELECT *, coalesce(abs(t) > {crit}, false) AS significant FROM c)
"""


def made(fn, *more):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pairs(spark, sf_dir), SPARSE, *more)

    return query


#: name: query and SQL.
ALL = {
    "window_features_ext": (made(samples.window_features_ext, BACK), extended_sql()),
    "forward_outcomes": (made(samples.forward_outcomes, AHEAD), outcomes_sql()),
    "regime_features": (made(samples.regime_features), regimes_sql()),
    "signal_screen": (lambda spark, d: screen(spark, d).drop("p"), screened_sql() + f"SELECT feature, target, n, {r('pearson', 'pearson')}, {r('spearman', 'spearman')}, {r('t', 't')}, {r('mean_size', 'mean_size')}, significant FROM tested"),
    "screen_summary": (
        lambda spark, d: signals.screen_summary(screen(spark, d), GROUPS),
        screened_sql() + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", target, count(*) AS features, {r('avg(mean_size)', 'mean_size')}, {r('max(mean_size)', 'max_size')}, count(*) FILTER (significant) AS significant FROM tested WHERE pearson IS NOT NULL AND spearman IS NOT NULL AND ({' OR '.join(f'contains(feature, {w!r})' for w in words)}) GROUP BY target" for g, words in GROUPS.items() if words),
    ),
}
