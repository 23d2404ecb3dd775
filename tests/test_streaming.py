"""A stream of trades gives the rows that the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tradeframe import catalog
from tradeframe.operators import trades, windows
from tradeframe.streaming.features import stream_actions, stream_forward_label, stream_segments, stream_trades, stream_window_feature_set, stream_window_features
from tradeframe.streaming.trades import stream_dedup, stream_first_hours, stream_ohlc

SF = "/root/testdata/sf0.001"


def collected(spark, df, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName("streamed").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table("streamed")


def test_bars_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = catalog.priced(spark, SF)
    last = rows.orderBy(F.col("us").desc()).limit(1).withColumn("block_timestamp", F.col("block_timestamp") + F.expr("interval 9 days"))
    rows.unionByName(last).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = collected(spark, stream_ohlc(stream.withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp")), "1 hour"), tmp_path)
    want = trades.ohlc(rows.withColumn("bar_us", F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000), ["mint", "bar_us"])
    key = lambda df, us: {(x["mint"], x["u"]): (x["open"], x["high"], x["low"], x["close"], x["transactions"]) for x in df.withColumn("u", us).collect()}
    got, want = key(got, F.unix_micros("start")), key(want, F.col("bar_us"))
    assert got == want


def test_copies_in_a_stream_go(spark, tmp_path):
    rows = catalog.norm(spark, SF).select("row_index", F.col("block_timestamp").cast("timestamp").alias("block_timestamp"))
    rows.unionAll(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = collected(spark, stream_dedup(stream, ["row_index"], "60 days"), tmp_path)
    assert got.count() == rows.count()


def stream_of(spark, tmp_path):
    """Trades with a last one some days on, so that the watermark passes all others; and the table itself."""
    rows = catalog.pairs(spark, SF).withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp"))
    last = rows.orderBy(F.col("us").desc()).limit(1).withColumn("block_timestamp", F.col("block_timestamp") + F.expr("interval 9 days"))
    rows.unionByName(last).write.parquet(str(tmp_path / "in"))
    return rows, stream_trades(spark, str(tmp_path / "in"), rows.schema)


def test_window_features_of_a_stream(spark, tmp_path):
    rows, stream = stream_of(spark, tmp_path)
    got = {(r.mint, r.sample_ts): r for r in collected(spark, stream_window_features(stream, (3600, 14_400), 7200), tmp_path).collect()}
    want = {}
    for r in rows.collect():
        s = r.block_timestamp.timestamp()
        end = (s // 7200 + 1) * 7200
        while end - 14_400 <= s:
            for width in (3600, 14_400):
                n, v, b = want.setdefault((r.mint, end), {}).get(width, (0, 0.0, 0.0))
                hit = end - s <= width
                want[r.mint, end][width] = (n + hit, v + hit * r.sol_amount, b + hit * r.is_buy * r.sol_amount)
            end += 7200
    assert {(m, t.timestamp()) for m, t in got} == set(want)
    for (m, t), r in got.items():
        for width in (3600, 14_400):
            n, v, b = want[m, t.timestamp()][width]
            assert r[f"trades_{width}s"] == n and abs(r[f"volume_{width}s"] - v) < 1e-6 and abs(r[f"buy_ratio_{width}s"] - (b / v if v else 0)) < 1e-9


def test_labels_of_a_stream(spark, tmp_path):
    rows, stream = stream_of(spark, tmp_path)
    got = collected(spark, stream_forward_label(stream, 36_000, 7200), tmp_path)
    want = rows.withColumn("k", F.explode(F.sequence(F.floor(F.col("us") / 7.2e9) - 4, F.floor(F.col("us") / 7.2e9)))).groupBy("mint", "k").agg(F.round(F.sum(F.when(F.col("is_buy"), F.col("sol_amount")).otherwise(0.0)), 6).alias("b"))
    key = lambda df: sorted((r[0], r[1], r[2]) for r in df.collect())
    assert key(got.select("mint", (F.unix_micros("sample_ts") / 7.2e9).cast("long"), F.round("forward_buy", 6))) == key(want)


def test_actions_and_segments(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "calm", 0.7), ("u2", "calm", 0.3), ("u3", "wild", 0.9), ("u4", "calm", 0.5), ("u5", None, 0.9)], "swapper string, regime string, score double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stream_trades(spark, str(tmp_path / "in"), rows.schema)
    profiles = spark.createDataFrame([("u1", 0.0), ("u2", 9.0)], "swapper string, x double")
    out = stream_segments(stream_actions(stream, spark.createDataFrame([("calm",)], "regime string")), profiles, ["x"], [[0.0], [10.0]], {0: "small"})
    got = {r.swapper: (r.action, r.segment) for r in collected(spark, out, tmp_path).collect()}
    assert got == {"u1": ("BUY", "small"), "u2": ("SELL", "Cluster 1"), "u3": ("HOLD", None), "u4": ("HOLD", None), "u5": ("HOLD", None)}


def test_first_hours_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    """Out of order within and across batches, but never later than the watermark allows."""
    rows = catalog.norm(spark, SF).where("mint is not null")
    wave = F.floor(F.col("us") / 86_400_000_000).cast("int")
    days = [r[0] for r in rows.select(wave).distinct().orderBy(wave).limit(8).collect()]
    rows = rows.where(wave.isin(days)).withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp"))
    for i, day in enumerate(days):  # each file has half of a day and half of the day before, in any order
        part = rows.where((wave == day) & (F.col("row_index") % 2 == 0) | (wave == (days[i - 1] if i else -1)) & (F.col("row_index") % 2 == 1))
        part.orderBy(F.hash("row_index")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = rows.limit(1).withColumns({"mint": F.lit("end"), "block_timestamp": F.timestamp_micros(F.lit((days[-1] + 9) * 86_400_000_000)), "us": F.lit((days[-1] + 9) * 86_400_000_000)})
    end.write.mode("append").parquet(str(tmp_path / "in"))
    for hours in (2.0, 60.0):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = collected(spark, stream_first_hours(stream, hours, "3 days"), tmp_path / str(hours))
        seen = rows.where((F.col("row_index") % 2 == 0) | (wave != days[-1]))
        want = trades.first_n_hours(seen, hours)
        key = lambda df: sorted((r.mint, r.row_index) for r in df.where("mint <> 'end'").collect())
        assert key(got) == key(want) != []


def test_feature_set_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    """A coin whose first trade is at a step's start has the stream's grid."""
    step = 7200
    rows = catalog.pairs(spark, SF).withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp"))
    first = rows.groupBy("mint").agg((F.floor(F.min("us") / (step * 1_000_000)) * step * 1_000_000).alias("f"))
    opening = rows.dropDuplicates(["mint"]).drop("us", "block_timestamp").join(first, "mint").withColumns({"us": F.col("f"), "block_timestamp": F.timestamp_micros("f"), "swapper": F.lit("opener"), "row_index": F.lit(-1).cast("long")}).drop("f")
    rows.unionByName(opening).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    end = rows.limit(1).withColumns({"mint": F.lit("end"), "block_timestamp": F.col("block_timestamp") + F.expr("interval 400 days")})
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    named = windows.SPARSE.windows
    got = collected(spark, stream_window_feature_set(stream, named, step), tmp_path).where("coin_id <> 'end'")
    batch = windows.window_features(rows, windows.SPARSE)
    names = [c for c in batch.columns if c in got.columns]
    assert len(names) == 2 + 23 * 3
    near = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = {r[:2]: r for r in map(near, got.select(names).collect())}
    checked = 0
    for r in map(near, batch.select(names).collect()):
        if r[:2] in got:  # samples without trades are not on the stream
            assert got[r[:2]] == pytest.approx(r, abs=2e-6)
            checked += 1
        else:
            assert not any(r[2:])
    assert checked > 500
