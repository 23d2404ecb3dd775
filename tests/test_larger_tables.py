"""What failed on larger tables: constant values, trades of nothing, many trades in a window."""

import math
import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe import catalog
from tradeframe.operators import clusters, flow, impact, joins, places, profiles, samples, signals, studies, trades, windows


def test_constant_targets_have_no_correlation(spark):
    rows = spark.range(40).select(F.col("id").cast("double").alias("score"), F.lit(1).alias("y"), F.lit(0.1).alias("z"), (F.col("id") % 7).alias("v"))
    got = {r.target: r for r in signals.corr_screen(rows.repartition(7), ("score",), ("y", "z", "v")).collect()}
    assert got["y"].r is None and got["y"].t is None and got["z"].r is None and abs(got["v"].r) < 1
    screened = {r.target: r for r in signals.rank_screen(rows, ("score",), ("y", "v")).collect()}
    assert screened["y"].pearson is None and not screened["y"].significant and screened["v"].pearson is not None


def test_frames_of_equal_values_have_no_correlation(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 6 else float(i), float(i)) for i in range(9)], "i int, x double, y double")
    got = [r.r for r in rows.withColumn("r", places.pair_corr("x", "y", Window.partitionBy(F.lit(1)).orderBy("i").rowsBetween(-2, 0))).orderBy("i").collect()]
    assert got[:6] == [None] * 6 and all(x > 0.5 for x in got[6:])


def test_flow_of_repeated_trades(spark):
    """One trade repeated: neither flow nor price varies."""
    rows = [("a", i, i, 2.0, 1000.0, True, 0.002) for i in range(30)]
    got = flow.flow_toxicity(spark.createDataFrame(rows, "mint string, us long, row_index long, sol_amount double, token_amount double, is_buy boolean, price double")).collect()
    assert len(got) == 1 and got[0].avg_flow_price_corr is None and got[0].total_transactions == 30


def test_frames_of_a_coins_own_width(spark):
    """Coins of 20, 30 and 60 trades have frames of 5, 7 and 10; all are one frame of the plan, not one for each width."""
    rows = [(m, i * 10, i, float(1 + i * i % 7), i % 3 > 0, 0.002 + (i * 5 % 11) / 1e4) for m, n in (("a", 20), ("b", 30), ("c", 60)) for i in range(n)]
    out = flow.flow_toxicity(spark.createDataFrame(rows, "mint string, us long, row_index long, sol_amount double, is_buy boolean, price double"))
    for r in out.collect():
        seen = [x for x in rows if x[0] == r.mint]
        k = min(10, len(seen) // 4)
        signed, price = [x[3] if x[4] else -x[3] for x in seen], [x[5] for x in seen]
        change = [None] + [b - a for a, b in zip(price, price[1:])]
        frames = [(signed[i - k + 1 : i + 1], change[i - k + 1 : i + 1]) for i in range(k, len(seen))]
        assert math.isclose(r.avg_flow_price_corr, statistics.fmean(statistics.correlation(x, y) for x, y in frames), rel_tol=1e-9)
        assert math.isclose(r.kyle_lambda_proxy, statistics.fmean(statistics.stdev(y) / statistics.fmean(map(abs, x)) for x, y in frames), rel_tol=1e-9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"specifiedwindowframe\((?:RowFrame|RangeFrame), -\d\d*, currentrow\$\(\)\)", plan))) == 1


def test_a_constant_column_in_many_parts(spark, parts):
    """(1 / 49) * 49 is below 1, so a deviation put together from parts of 49 rows is above 0."""
    rows = spark.range(0, parts * parts, 1, parts).select(F.lit(1).alias("same"), F.col("id").alias("other"), F.lit(None).cast("double").alias("none"))
    assert {r.feature: r.constant for r in clusters.constant_columns(rows, ["same", "other", "none"]).collect()} == {"same": True, "other": False, "none": True}


def test_trades_of_nothing_have_no_price(spark):
    """The row of nothing for nothing makes the mean of the next frames NaN, as SQL does; its signal is asked though no quote is at its time."""
    rows = [("a", i * 10_000_000, i, 0.0 if i == 60 else 2.0, 0.0 if i == 60 else 1000.0, i % 2 == 0) for i in range(100)]
    pairs = spark.createDataFrame(rows, "mint string, us long, row_index long, sol_amount double, token_amount double, is_buy boolean")
    found = impact.reversion_signals(pairs)
    got = {r.row_index: r for r in found.collect()}
    assert set(range(60, 80)) <= set(got) and all(got[i].side == "SELL" and "price" in got[i].reasons and math.isnan(got[i].strength) for i in range(60, 80))
    quotes = pairs.where("sol_amount > 0").withColumn("price", F.lit(0.002)).select("mint", "us", "row_index", "price")
    assert impact.evaluate_exit_price(found, quotes, (30,)).where("side = 'SELL'").first().num_trades == sum(r.side == "SELL" for r in got.values())


def test_windows_after_events_against_pairs(spark, closed):
    """Ties at the event's time, at a window's end and at the bound of two stretches, groups without trades, null groups."""
    seen = [("a", (i * 7 % 40) * 1_000_000, i, float(i * 13 % 17), float(i)) for i in range(60)] + [(None, 3_000_000, 99, 1.0, 1.0), ("a", None, 98, 1.0, 1.0)]
    asked = [("a", t * 1_000_000, t) for t in (0, 3, 10, 19, 20, 39, 55)] + [("b", 0, 100), (None, 3_000_000, 101)]
    got = joins.event_window_stats(spark.createDataFrame(asked, "mint string, us long, event long"), spark.createDataFrame(seen, "mint string, us long, row_index long, price double, size double"), "price", (10, 20), closed=closed, amount="size").collect()
    assert len(got) == 2 * len(asked)
    for r in got:
        inside = [s for s in seen if s[0] == r.mint and r.mint is not None and s[1] is not None and (r.us <= s[1] if closed else r.us < s[1]) and s[1] <= r.us + r.window_s * 1_000_000]
        want = (len(inside), sum(s[4] for s in inside), min(s[3] for s in inside), max(s[3] for s in inside), max((s[1], s[2], s[3]) for s in inside)[2]) if inside else (0, None, None, None, None)
        assert (r.n, r.total, r.least, r.greatest, r.last) == want


def test_windows_after_events_are_not_pairs(spark):
    """No step holds more rows than events and trades in both stretches, however many meet."""
    seen = spark.range(2000).select(F.lit("a").alias("mint"), F.col("id").alias("us"), F.col("id").alias("row_index"), F.lit(1.0).alias("price"))
    out = joins.event_window_stats(seen.select("mint", "us", F.col("row_index").alias("event")), seen, "price", (10,))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.agg(F.sum("n")).first()[0] == 2000 * 1999 // 2


def test_what_comes_back_as_it_was_spent_is_no_gain(spark):
    """0.1 + 0.2 is above 0.3."""
    rows = [("u", "a", 1, 0.1, False), ("u", "a", 2, 0.2, False), ("u", "a", 3, 0.3, True)]
    norm = spark.createDataFrame(rows, "swapper string, mint string, us long, sol_amount double, is_buy boolean").withColumn("is_sell", ~F.col("is_buy"))
    held = trades.positions(norm)
    assert trades.coin_pnl(held).first().winners == 0 and trades.trader_pnl(held).first().win_rate == 0
    total = profiles.trader_total_pnl(held).first()
    assert (total.profitable_coins, total.is_profitable, total.total_pnl) == (0, False, 0.0)


def test_sums_of_windows_are_not_held_by_trader(spark):
    """Only flags are kept for each trader of a sample; the sums have a row a sample."""
    rows = [("a", i * 1_000_000, f"u{i % 50}", i % 2 == 0, i % 2 == 1, float(i % 5)) for i in range(600)]
    pairs = spark.createDataFrame(rows, "mint string, us long, swapper string, is_buy boolean, is_sell boolean, sol_amount double")
    plan = windows.window_features(pairs, windows.GridConfig())._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.splitlines() if "Aggregate [mint" in line and "swapper" in line.split("], [")[0]]
    assert held and not any("sum(" in line for line in held)
    got = samples.forward_outcomes(pairs, windows.GridConfig(), (60,)).where("sample_us = 120000000").first()
    assert (got.forward_transaction_count, got.forward_unique_traders) == (60, 50)


def test_traders_are_dealt_only_where_they_are_asked_for(spark):
    """A window's sums alone have no step for traders; trades after a sample are in no trader's window."""
    rows = [("a", i * 1_000_000, f"u{i}", i % 2 == 0, i % 2 == 1, float(i % 5)) for i in range(600)]
    pairs = spark.createDataFrame(rows, "mint string, us long, swapper string, is_buy boolean, is_sell boolean, sol_amount double")
    out = windows.window_features(pairs, windows.GridConfig())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(out.select("sample_us", "buy_ratio_30s", "is_profitable_300s"))
    dealt = plan(out).split("RepartitionByExpression [mint", 1)[1]
    assert "swapper" in dealt.split("]", 1)[0] and next(line for line in dealt.splitlines() if "Filter" in line).endswith("> 0)")
    got = {r.sample_us: (r.unique_traders_30s, r.unique_buyers_60s, r.unique_sellers_120s) for r in out.collect()}
    assert len(got) == 3 and set(got.values()) == {(30, 30, 60)}


def test_halves_are_rounded_as_in_sql(spark):
    rows = spark.createDataFrame([(23.49 / 7200,), (-23.49 / 7200,), (1.25e-7,), (float("nan"),), (float("inf"),), (None,)], "x double")
    got = [r.x for r in catalog.round_all(rows).collect()]
    assert got[:3] == [0.003263, -0.003263, 0.0] and math.isnan(got[3]) and got[4:] == [math.inf, None]


def cancelled(spark, folder):
    """Traders whose amounts cancel out: u0's doubles come to more in any order, u1's in the order of rows alone, u2's to 0; u3
    gains, one has no name."""
    rows = [(0, e, v, k) for e in "abc" for v, k in ((0.3, 0), (0.1, 1), (0.2, 1))] + [(1, "a", v, k) for v, k in ((0.1, 1), (0.2, 1), (0.3, 1), (0.6, 0))]
    rows += [(2, "a", v, k) for v, k in ((0.3, 1), (0.2, 1), (0.1, 1), (0.6, 0))] + [(3, e, 5.0 + i, 1) for i, e in enumerate("abc")] + [(None, "a", v, k) for v, k in ((0.3, 0), (0.1, 1), (0.2, 1))]
    events = spark.createDataFrame([(i, i, u, e, v, f'{{"k": {k}}}') for i, (u, e, v, k) in enumerate(rows)], "event_id long, s long, user_id long, event_type string, value double, props string")
    events.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")


def assert_equals_sql(spark, folder, name):
    """SQL's sums on one thread are in the order of rows."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(catalog.ORACLE_SQL[name])
    plain = lambda rows: sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(got.select(*(d[0] for d in want.description)).collect()) == plain(want.fetchall())


def test_signs_of_results_that_cancel_out_follow_rows(spark):
    """Whatever the parts that the rows are in; positions that don't cancel out are as they were."""
    paid = [("u", 0.3, False), ("v", 0.6, False), ("w", 0.6, False), ("x", 1.0, False), (None, 0.3, False)]
    got = [("u", 0.1), ("u", 0.2), ("v", 0.1), ("v", 0.2), ("v", 0.3), ("w", 0.3), ("w", 0.2), ("w", 0.1), ("x", 1.5), (None, 0.1), (None, 0.2)]
    rows = [(s, "a", i, i, v, sell) for i, (s, v, sell) in enumerate(paid + [(s, v, True) for s, v in got])]
    norm = spark.createDataFrame(rows, "swapper string, mint string, us long, row_index long, sol_amount double, is_sell boolean").withColumn("is_buy", ~F.col("is_sell"))
    for parts in (1, 3, 7):
        held = trades.positions_in_order(norm.repartition(parts, F.hash("row_index", F.lit(parts))))
        assert held.columns == trades.positions(norm).columns
        net = {r.swapper: r.net_sol_pnl_per_coin for r in held.collect()}
        assert net == {"u": 0.1 + 0.2 - 0.3, "v": 0.1 + 0.2 + 0.3 - 0.6, "w": 0.0, "x": 0.5, None: 0.1 + 0.2 - 0.3} and net["u"] > 0 and net["v"] > 0


def test_coin_pnl_of_cancelled_trades(spark, tmp_path):
    cancelled(spark, tmp_path)
    assert_equals_sql(spark, tmp_path, "coin_pnl")


def test_marked_pnl_of_cancelled_trades(spark, tmp_path):
    """u0 has three coins that gain by SQL's sums, so it is no trader that is marked."""
    cancelled(spark, tmp_path)
    assert_equals_sql(spark, tmp_path, "marked_pnl")


def test_trader_pnl_of_cancelled_trades(spark, tmp_path):
    cancelled(spark, tmp_path)
    assert_equals_sql(spark, tmp_path, "trader_pnl")


def test_trader_total_pnl_of_cancelled_trades(spark, tmp_path):
    cancelled(spark, tmp_path)
    assert_equals_sql(spark, tmp_path, "trader_total_pnl")


def test_coins_launched_since_have_their_traders(spark):
    """A trader counts once a coin, one without a name not at all; a coin's earlier trades are its own, so an old coin is left out."""
    rows = [("a", 5, "u", True), ("a", 6, "u", False), ("a", 9, "v", True), ("a", 7, None, True), ("b", 4, "w", True), ("b", 8, "x", True), (None, 6, "u", True)]
    trades_of = spark.createDataFrame(rows, "mint string, us long, swapper string, succeeded boolean").repartition(5)
    got = {tuple(r) for r in studies.launched_since(trades_of, 5).select("mint", "first_us", "last_us", "trades", "traders", "succeeded").collect()}
    assert got == {("a", 5, 9, 4, 2, 3), (None, 6, 6, 1, 1, 1)}
