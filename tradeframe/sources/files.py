"""Readers and writers of the files that trades, bars and prediction markets come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADES = "mint string, block_timestamp timestamp, succeeded boolean, swapper string, swap_from_amount double, swap_from_mint string, swap_to_amount double, swap_to_mint string, __row_index bigint"
MARKET_TRADE = "conditionId string, asset string, side string, price string, size string, timestamp string, proxyWallet string"
MARKET = "id string, conditionId string, question string, volume string, closed boolean, endDate string, clobTokenIds string, outcomes string"
PAIRS = "pairs array<struct<baseToken: struct<address: string>, liquidity: struct<usd: double>, fdv: double>>"


def read_trades(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Trades of all files of a folder, or of several; Spark leaves out names that begin with a dot."""
    reader = spark.read.schema(TRADES)
    return (reader.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path) if fmt == "csv" else reader.format(fmt).load(path)).withColumnRenamed("__row_index", "row_index")


def read_daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars, a file a day, whose name holds the date; exact repeats go."""
    rows = spark.read.schema("time string, open double, high double, low double, close double, vwap double, volume double, transactions bigint").option("header", True).csv(path)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)
    named = rows.select(day.cast("date").alias("date"), day.alias("date_str"), F.to_timestamp(F.concat_ws(" ", day, "time")).alias("datetime"), "*")
    return named.dropDuplicates()


def read_paged_json(spark: SparkSession, path: str) -> DataFrame:
    """The rows of paged results, each page a document with result.rows."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("result.rows").alias("row")).select("row.*")


def explode_markets(events: DataFrame) -> DataFrame:
    """A row for each market of events (id, title, markets); one of nulls where an event has none. Token ids are decoded from
    their text, null where that is no list; outcomes are Yes and No where there are none."""
    rows = events.select(F.col("id").alias("event_id"), "title", F.explode_outer("markets").alias("m"))
    tokens = F.from_json("m.clobTokenIds", "array<string>")
    outcomes = F.coalesce(F.from_json("m.outcomes", "array<string>"), F.array(F.lit("Yes"), F.lit("No")))
    return rows.select("event_id", "title", F.col("m.id").alias("market_id"), F.col("m.conditionId").alias("condition_id"), F.col("m.question").alias("question"), F.col("m.volume").try_cast("double").alias("volume"), "m.closed", tokens.alias("token_ids"), outcomes.alias("outcomes"))


def read_market_trades(spark: SparkSession, path: str, condition_id: str) -> DataFrame:
    """Typed trades of one market; what can't be read as a number is null."""
    rows = spark.read.schema(MARKET_TRADE).json(path).where(F.lower("conditionId") == condition_id.lower())
    return rows.select("conditionId", "asset", "side", F.col("price").try_cast("double").alias("price"), F.col("size").try_cast("double").alias("size"), F.timestamp_seconds(F.col("timestamp").try_cast("bigint")).alias("ts"), F.col("proxyWallet").alias("trader"))


def normalise_price_history(points: DataFrame) -> DataFrame:
    """(token, ts, price) of points (token, t or timestamp, p or price), in seconds; without a time they go."""
    has = lambda *names: F.coalesce(*(F.col(n) for n in names if n in points.columns))
    rows = points.select("token", has("t", "timestamp").try_cast("bigint").alias("ts"), has("p", "price").try_cast("double").alias("price"))
    return rows.where("ts is not null")


def best_pair(tokens: DataFrame) -> DataFrame:
    """(mint_address, liquidity, fdv): of the pairs in each token's metadata that have it as base, the most liquid."""
    pair = tokens.select("mint_address", F.explode(F.from_json("dexscreener_data", PAIRS)["pairs"]).alias("p")).where(F.col("p.baseToken.address") == F.col("mint_address"))
    liquid = F.coalesce("p.liquidity.usd", F.lit(0.0))
    best = pair.groupBy("mint_address").agg(F.max(F.struct(liquid.alias("liquidity"), F.col("p.fdv").alias("fdv"))).alias("best"))
    return best.select("mint_address", "best.liquidity", "best.fdv")


def write_output(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Write as csv, json or parquet; by: a folder for each value."""
    writer = df.write.mode("overwrite").format(fmt)
    writer = writer.option("header", True) if fmt == "csv" else writer
    (writer.partitionBy(*by) if by else writer).save(path)


def write_bars(bars: DataFrame, path: str, by: str | None = None) -> None:
    """One table of bars, or a folder for each coin."""
    write_output(bars.repartition(by) if by else bars, path, by=[by] if by else None)
