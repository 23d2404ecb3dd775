"""Queries of `operators.tables` and `sources.files` with their SQL; `catalog` registers them with its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.operators import tables
from tradeframe.operators.trades import normalise_trades
from tradeframe.sources import files
from tradeframe.sources.tables import TRADES_SQL, table, trades


def norm(spark: SparkSession, d: str) -> DataFrame:
    return normalise_trades(trades(spark, d))


def meta(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of tokens: customers, of whom each hundredth has none; what they have is their valuation."""
    return table(spark, d, "customer").where("c_custkey % 100 <> 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("mint"), (F.col("c_acctbal").cast("double") * 1e6).alias("fdv"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and their volumes: what customers have ordered."""
    return table(spark, d, "orders").groupBy(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("mint")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("usd_volume"))


META = "meta AS (SELECT 'm' || c_custkey AS mint, CAST(c_acctbal AS DOUBLE) * 1e6 AS fdv FROM customer WHERE c_custkey % 100 <> 0)"
TOKENS = "tokens AS (SELECT 'm' || o_custkey AS mint, sum(CAST(o_totalprice AS DOUBLE)) AS usd_volume FROM orders GROUP BY ALL)"
EVENTS = "SELECT event_id, event_type, value"
Q = "quantile_cont(value, {})"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.col("value").cast("double").alias("value"))


def orders_json(spark: SparkSession, d: str) -> DataFrame:
    """Events with markets: orders and their lines; every tenth line's token ids are no list."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("0x"), F.hex("l_partkey")).alias("conditionId"), F.col("l_returnflag").alias("question"), F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("volume"),
            (F.col("l_linestatus") == "F").alias("closed"), F.when(F.col("l_suppkey") % 10 == 0, "broken").otherwise(F.concat(F.lit('["'), F.col("l_partkey").cast("string"), F.lit('","'), F.col("l_suppkey").cast("string"), F.lit('"]'))).alias("clobTokenIds"), F.lit(None).cast("string").alias("outcomes"),
        ).alias("m"),
    )
    markets = lines.groupBy("l_orderkey").agg(F.to_json(F.collect_list("m")).alias("json"))
    kind = "array<struct<id: string, conditionId: string, question: string, volume: string, closed: boolean, clobTokenIds: string, outcomes: string>>"
    return table(spark, d, "orders").join(markets, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.from_json("json", kind).alias("markets"))


def pairs_json(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of suppliers as text; every fourth line is another one's pair."""
    address = F.when(F.col("l_linenumber") % 4 == 0, "other").otherwise(F.col("l_suppkey").cast("string"))
    pair = F.struct(F.struct(address.alias("address")).alias("baseToken"), F.struct(F.col("l_partkey").cast("double").alias("usd")).alias("liquidity"), F.col("l_orderkey").cast("double").alias("fdv"))
    pairs = F.to_json(F.struct(F.collect_list(pair).alias("pairs")))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("mint_address")).agg(pairs.alias("dexscreener_data"))


def register(add, r) -> None:
    add("launchpad_flag", lambda s, d: events(s, d).select("event_id", tables.is_launchpad(F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.lit("PUMP")).otherwise(F.lit("x")))).alias("launchpad")),
        "SELECT event_id, lower(event_type || CASE WHEN event_id % 3 = 0 THEN 'PUMP' ELSE 'x' END) LIKE '%pump' AS launchpad FROM events")
    add("time_slice", lambda s, d: tables.time_slice(norm(s, d), "2024-01-10", "2024-01-20", ["row_index", "mint", "swapper"]),
        TRADES_SQL + "SELECT row_index, mint, swapper FROM norm WHERE block_timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
    add("restrict_tokens", lambda s, d: tables.restrict_tokens(tokens(s, d), meta(s, d).where("fdv > 5e9")), f"WITH {META}, {TOKENS} SELECT mint, {r('usd_volume', 'usd_volume')} FROM tokens WHERE mint IN (SELECT mint FROM meta WHERE fdv > 5e9)")
    add("missing_keys", lambda s, d: tables.missing_keys(tokens(s, d), meta(s, d), "mint"), f"WITH {META}, {TOKENS} SELECT mint FROM tokens WHERE mint NOT IN (SELECT mint FROM meta)")
    add("low_fdv_tokens", lambda s, d: tables.low_fdv_tokens(meta(s, d), tokens(s, d)), f"WITH {META}, {TOKENS} SELECT mint FROM meta WHERE fdv < 1e9 UNION SELECT mint FROM tokens WHERE mint NOT IN (SELECT mint FROM meta)")
    add("enrich_tokens", lambda s, d: tables.enrich_tokens(tokens(s, d), meta(s, d)), f"WITH {META}, {TOKENS} SELECT t.mint, {r('usd_volume', 'usd_volume')}, {r('fdv', 'fdv')}, m.mint IS NOT NULL AS known FROM tokens t LEFT JOIN meta m ON t.mint = m.mint")
    add("union_sources", lambda s, d: tables.union_sources(norm(s, d).where("succeeded").select("row_index", "mint"), norm(s, d).where("not succeeded").select("mint", "row_index")), TRADES_SQL + "SELECT row_index, mint FROM norm WHERE succeeded UNION ALL SELECT row_index, mint FROM norm WHERE NOT succeeded")
    add("first_by_id", lambda s, d: tables.first_by_id(events(s, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]),
        "SELECT user_id, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
    add("split_where", lambda s, d: tables.union_sources(*(x.withColumn("part", F.lit(i)) for i, x in enumerate(tables.split_where(events(s, d).select("event_id", "value"), F.col("value") > 50)))),
        f"SELECT event_id, {r('value', 'value')}, CAST(CASE WHEN value > 50 THEN 0 ELSE 1 END AS INTEGER) AS part FROM events")
    add("top_n", lambda s, d: tables.top_n(events(s, d).select("event_id", "value"), [F.desc("value"), F.col("event_id")], 25), f"SELECT event_id, {r('value', 'value')} FROM events ORDER BY events.value DESC, event_id LIMIT 25")
    add("label_keys", lambda s, d: tables.label_keys(events(s, d), "user_id", "ts", "Coin_"), "SELECT user_id, 'Coin_' || row_number() OVER (ORDER BY min(ts), user_id) AS label FROM events GROUP BY user_id")
    add("merge_signals", lambda s, d: tables.merge_signals(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), table(s, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), ["o_orderkey"]),
        "SELECT o_orderkey, o_orderpriority, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2")
    spec = {"value": "log1p", "up": "sqrt", "shift": "signed_log", "share": "log10", "low": "square", "down": "cbrt"}
    add("transform_features", lambda s, d: tables.transform_features(events(s, d).selectExpr("event_id", "value", "value as up", "value - 50 as shift", "value - 20 as share", "value / 7 as low", "20 - value as down"), spec).select("event_id", *(f"{c}_{t}" for c, t in spec.items())),
        f"""SELECT event_id, {r('ln(1 + value)', 'value_log1p')}, {r('sqrt(value)', 'up_sqrt')}, {r('sign(value - 50) * ln(1 + abs(value - 50))', 'shift_signed_log')}, {r('CASE WHEN value > 20 THEN log10(value - 20) END', 'share_log10')},
  {r('(value / 7) * (value / 7)', 'low_square')}, {r('sign(20 - value) * pow(abs(20 - value), 1e0 / 3)', 'down_cbrt')} FROM events""")  # fmt: skip
    holes = ["event_id", "case when event_id % 7 = 0 then cast('Infinity' as double) when event_id % 5 = 0 then null else value end as a", "case when event_id % 3 = 0 then null else value end as b"]
    add("clean_features", lambda s, d: tables.clean_features(events(s, d).selectExpr(*holes), ["a"], ["b"]),
        f"SELECT event_id, {r('CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0e0 ELSE value END', 'a')}, {r('CASE WHEN event_id % 3 = 0 THEN (SELECT max(value) FROM events WHERE event_id % 3 <> 0) + 1 ELSE value END', 'b')}, event_id % 3 <> 0 AS has_b FROM events")
    fence = f"low AS (SELECT {Q.format(0.25)} AS a, {Q.format(0.75)} AS b FROM events)"
    add("clip_iqr", lambda s, d: tables.clip_iqr(events(s, d).select("event_id", "value"), ["value"], 0.5), f"WITH {fence} SELECT event_id, {r('greatest(least(value, b + 0.5 * (b - a)), a - 0.5 * (b - a))', 'value')} FROM events, low")
    add("outliers_iqr", lambda s, d: tables.outliers(events(s, d).select("event_id", "value"), "value", "iqr", 1.0), f"WITH {fence} SELECT event_id, {r('value', 'value')} FROM events, low WHERE events.value < a - (b - a) OR events.value > b + (b - a)")
    add("outliers_zscore", lambda s, d: tables.outliers(events(s, d).select("event_id", "value"), "value", "zscore", 1.5), f"WITH low AS (SELECT avg(value) AS a, stddev_samp(value) AS b FROM events) SELECT event_id, {r('value', 'value')} FROM events, low WHERE abs(events.value - a) > 1.5 * b")
    add("value_bands", lambda s, d: events(s, d).groupBy(tables.band(F.col("value"), [0, 10, 25, 50, 100], ["low", "mid", "high", "top"]).alias("band")).agg(F.count("*").alias("n")),
        "SELECT CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 25 THEN 'mid' WHEN value > 25 AND value <= 50 THEN 'high' WHEN value > 50 AND value <= 100 THEN 'top' END AS band, count(*) AS n FROM events GROUP BY ALL")
    add("short_address", lambda s, d: table(s, d, "documents").select("doc_id", tables.short_address(F.md5(F.col("doc_id").cast("string"))).alias("short"), tables.short_address(F.col("lang")).alias("lang")),
        "SELECT doc_id, left(md5(CAST(doc_id AS VARCHAR)), 6) || '...' || right(md5(CAST(doc_id AS VARCHAR)), 4) AS short, lang FROM documents")
    add("profile_table", lambda s, d: tables.profile_table(events(s, d), ["event_type", "user_id"], 5),
        """WITH c AS (SELECT 'event_type' AS "column", event_type AS value, count(*) AS rows FROM events GROUP BY ALL UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, value) AS INTEGER) AS nth FROM c QUALIFY nth <= 5""")  # fmt: skip
    lines = ["l_quantity", "l_extendedprice", "l_discount"]
    add("corr_matrix", lambda s, d: tables.corr_matrix(table(s, d, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in lines)), lines),
        " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 'corr')} FROM lineitem" for i, a in enumerate(lines) for b in lines[i + 1 :]))
    add("compare_log", lambda s, d: tables.compare_log(table(s, d, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in lines)), lines[:2], lines[2]),
        " UNION ALL ".join(f"SELECT '{a}' AS metric, {r(f'corr(CAST({a} AS DOUBLE), CAST(l_discount AS DOUBLE))', 'raw_corr')}, {r(f'corr(ln(1 + CAST({a} AS DOUBLE)), CAST(l_discount AS DOUBLE))', 'log_corr')} FROM lineitem" for a in lines[:2]))
    by_user = "(SELECT user_id, sum(value) - 1000 AS v FROM events GROUP BY user_id)"
    add("result_summary", lambda s, d: tables.result_summary(events(s, d).groupBy("user_id").agg((F.sum("value") - 1000).alias("v")).withColumn("v", F.round("v", 9)), "user_id", "v"),
        f"SELECT count(*) AS n, {r('avg(v)', 'mean')}, {r('median(v)', 'median')}, {r('max(v)', 'best')}, arg_max(user_id, (round(v, 9), user_id)) AS best_key, {r('min(v)', 'worst')}, arg_min(user_id, (round(v, 9), user_id)) AS worst_key, {r('count(*) FILTER (v > 0) * 1e0 / count(*)', 'share_profitable')} FROM {by_user}")
    add("coin_sample_summary", lambda s, d: tables.coin_sample_summary(events(s, d).select(F.col("user_id").alias("coin_id"), (F.col("event_id") % 11).alias("total_transactions")), 20),
        "SELECT user_id AS coin_id, CAST(sum(event_id % 11) AS BIGINT) AS transactions, count(*) AS samples FROM events GROUP BY user_id ORDER BY transactions DESC, coin_id LIMIT 20")
    add("explode_markets", lambda s, d: files.explode_markets(orders_json(s, d)).select("event_id", "title", "market_id", "condition_id", "question", "volume", "closed", F.array_join("token_ids", ",").alias("token_ids"), F.array_join("outcomes", ",").alias("outcomes")),
        """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderpriority AS title, l_orderkey || '-' || l_linenumber AS market_id, CASE WHEN l_partkey IS NOT NULL THEN '0x' || upper(to_hex(l_partkey)) END AS condition_id, l_returnflag AS question,
  CASE WHEN l_linenumber % 3 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS volume, l_linestatus = 'F' AS closed, CASE WHEN l_suppkey % 10 <> 0 THEN l_partkey || ',' || l_suppkey END AS token_ids, 'Yes,No' AS outcomes
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")  # fmt: skip
    add("price_history", lambda s, d: files.normalise_price_history(events(s, d).select(F.col("event_type").alias("token"), F.when(F.col("event_id") % 9 == 0, "bad").when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("t"), F.when(F.col("event_id") % 2 == 1, F.col("event_id").cast("string")).alias("timestamp"), F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).alias("p"), F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("price"))),
        f"SELECT event_type AS token, event_id AS ts, {r('value', 'price')} FROM events WHERE event_id % 9 <> 0")
    add("best_pair", lambda s, d: files.best_pair(pairs_json(s, d)),
        "SELECT CAST(l_suppkey AS VARCHAR) AS mint_address, CAST(max(l_partkey) AS DOUBLE) AS liquidity, CAST(arg_max(l_orderkey, (l_partkey, l_orderkey)) AS DOUBLE) AS fdv FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY l_suppkey")
    DRAWN = "md5('42|' || event_id)"
    add("cap_per_key", lambda s, d: tables.cap_per_key(events(s, d), "user_id", 3, ["event_id"]).select("user_id", "event_id"), f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {DRAWN}, event_id) <= 3")
    add("stratified_sample", lambda s, d: tables.stratified_sample(events(s, d), "value", 5, 40, ["event_id"]).select("stratum", "event_id"),
        f"""WITH q AS (SELECT {', '.join(f'{Q.format(i / 5)} AS q{i}' for i in range(1, 5))} FROM events), b AS (SELECT event_id, CAST({' + '.join(f'(value > q{i})::INTEGER' for i in range(1, 5))} AS INTEGER) AS stratum FROM events, q)
SELECT stratum, event_id FROM b QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {DRAWN}, event_id) <= 40""")  # fmt: skip
    add("sample_rows", lambda s, d: tables.sample_rows(events(s, d), 100, ["event_id"]).select("event_id"), f"SELECT event_id FROM events ORDER BY {DRAWN}, event_id LIMIT 100")
    add("sample_share", lambda s, d: tables.sample_share(events(s, d), 0.1, ["event_id"]).select("event_id"), f"SELECT event_id FROM events WHERE CAST('0x' || substr({DRAWN}, 1, 8) AS BIGINT) < {int(0.1 * (1 << 32))}")
    inspected = ["event_type", "user_id"]
    plain = lambda c: f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS known, CAST(min({c}) AS VARCHAR) AS first, CAST(max({c}) AS VARCHAR) AS last, NULL::BIGINT AS days, count(DISTINCT {c}) AS distinct_values FROM events"""
    add("table_ranges", lambda s, d: tables.table_ranges(events(s, d), ["ts"], inspected),
        """SELECT 'ts' AS "column", count(*) AS rows, count(ts) AS known, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT ts) AS distinct_values FROM events UNION ALL """ + " UNION ALL ".join(map(plain, inspected)))  # fmt: skip
    add("human_numbers", lambda s, d: events(s, d).select("event_id", tables.human_number(F.round(F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 9), 0)).alias("text")),
        """SELECT event_id, CASE WHEN abs(v) >= 1e9 THEN printf('%,.1f', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN printf('%,.1f', v / 1e6) || 'M' WHEN abs(v) >= 1e3 THEN printf('%,.1f', v / 1e3) || 'K' ELSE printf('%,.1f', v) END AS text FROM (SELECT event_id, round(value * 10 ** (event_id % 9), 0) AS v FROM events)""")  # fmt: skip
