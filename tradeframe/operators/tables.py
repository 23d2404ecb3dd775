"""Operators over any table: selections, set operations, joins with metadata, feature preparation, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.operators.places import pair_corr, quantiles, ranked, with_cuts

# selections


def is_launchpad(address: Column) -> Column:
    """Addresses that a launchpad gave out end in its name."""
    return F.lower(address).endswith("pump")


def time_slice(df: DataFrame, start: str, end: str, columns: list[str], ts: str = "block_timestamp") -> DataFrame:
    """Rows from start to end, both included."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).select(*columns)


def restrict_tokens(df: DataFrame, tokens: DataFrame, key: str = "mint") -> DataFrame:
    """Rows of the listed tokens."""
    return df.join(tokens.select(key), key, "left_semi")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right doesn't have."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def low_fdv_tokens(meta: DataFrame, tokens: DataFrame, most: float = 1e9, key: str = "mint") -> DataFrame:
    """Tokens valued below `most`, and those without metadata."""
    return meta.where(F.col("fdv") < most).select(key).unionByName(missing_keys(tokens, meta, key)).distinct()


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def first_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; ends in a partial sum, not in a window over a key's rows."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(key, *(F.col(f"first.{c}").alias(c) for c in rest))


def split_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition holds, and all others."""
    return df.where(condition), df.where(~F.coalesce(condition, F.lit(False)))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; the order should end in a column that tells rows apart."""
    return df.orderBy(*order).limit(n)


def drawn(by: list[str], seed: int) -> Column:
    """A text that orders rows as if by chance, always in the same way: the digest of a seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by)).cast("binary"))


def cap_per_key(df: DataFrame, key: str, n: int, by: list[str], seed: int = 42) -> DataFrame:
    """n rows of each key at most, chosen by a digest of the columns `by`, so always the same ones. Spark cuts each task's rows to
    n a key before it deals them."""
    order = Window.partitionBy(key).orderBy(drawn(by, seed), *by)
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def sample_rows(df: DataFrame, n: int, by: list[str], seed: int = 42) -> DataFrame:
    """n rows, chosen by a digest of the columns `by`."""
    return df.orderBy(drawn(by, seed), *by).limit(n)


def sample_share(df: DataFrame, share: float, by: list[str], seed: int = 42) -> DataFrame:
    """Each row with the chance `share`, by a digest of the columns `by`: the same rows on every run and however the table is dealt."""
    return df.where(F.conv(F.substring(drawn(by, seed), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))


def stratified_sample(df: DataFrame, column: str, strata: int, n: int, by: list[str], seed: int = 42) -> DataFrame:
    """n rows at most of each of `strata` bands of equal share of a column; bands are cut at its exact percentiles. A null is in
    the first."""
    names = [f"__cut{i}" for i in range(1, strata)]
    banded = with_cuts(df, quantiles(df, [], column, {c: (i + 1) / strata for i, c in enumerate(names)}))
    banded = banded.withColumn("stratum", sum((F.when(F.col(column) > F.col(c), 1).otherwise(0) for c in names), F.lit(0)))
    return cap_per_key(banded.drop(*names), "stratum", n, by, seed)


def label_keys(df: DataFrame, key: str, first: str, prefix: str) -> DataFrame:
    """(key, label): keys numbered from 1 in the order in which they are first seen; ties by key. A row a key is numbered."""
    seen = df.groupBy(key).agg(F.min(first).alias("_first"))
    return ranked(seen, [], ["_first", key], "_place").select(key, F.concat(F.lit(prefix), (F.col("_place") + 1).cast("string")).alias("label"))


# joins


def enrich_tokens(volumes: DataFrame, meta: DataFrame, key: str = "mint") -> DataFrame:
    """Every token, with its metadata where there are some, and whether it is known."""
    return volumes.join(meta.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merge_signals(candles: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Candles that a signal has been given for."""
    return candles.join(signals, keys)


# features


def signed(x: Column, f) -> Column:
    return F.signum(x) * f(F.abs(x))


TRANSFORMS = {
    "log1p": F.log1p,
    "sqrt": F.sqrt,
    "signed_log": lambda x: signed(x, F.log1p),
    "log10": lambda x: F.when(x > 0, F.log10(x)),
    "square": lambda x: x * x,
    "cbrt": lambda x: signed(x, lambda y: F.pow(y, F.lit(1 / 3))),
}


def transform_features(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add <column>_<transform> for each; log10 is null where there is none."""
    return df.withColumns({f"{c}_{t}": TRANSFORMS[t](F.col(c)) for c, t in spec.items()})


def clean_features(df: DataFrame, zero: list[str], flagged: list[str]) -> DataFrame:
    """Null and not finite become 0 in `zero`. In `flagged` null becomes the greatest value plus 1, and has_<column> tells."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    out = df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in zero}) if zero else df
    if not flagged:
        return out
    most = df.agg(*(F.max(c).alias(f"_max_{c}") for c in flagged))
    out = out.crossJoin(F.broadcast(most)).withColumns({f"has_{c}": F.col(c).isNotNull() for c in flagged})
    return out.withColumns({c: F.coalesce(F.col(c), F.coalesce(F.col(f"_max_{c}"), F.lit(0)) + 1) for c in flagged}).drop(*(f"_max_{c}" for c in flagged))


def _fences(df: DataFrame, columns: list[str], k: float) -> DataFrame:
    """One row: low_<c> and high_<c>, k quartile ranges beyond the quartiles."""
    out = None
    for c in columns:
        of = quantiles(df, [], c, {f"_a_{c}": 0.25, f"_b_{c}": 0.75})
        out = of if out is None else with_cuts(out, of)
    a, b = (lambda c: F.col(f"_a_{c}")), (lambda c: F.col(f"_b_{c}"))
    return out.select(*(x for c in columns for x in ((a(c) - k * (b(c) - a(c))).alias(f"low_{c}"), (b(c) + k * (b(c) - a(c))).alias(f"high_{c}"))))


def clip_iqr(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Values drawn to the fences k quartile ranges beyond the quartiles; null stays null."""
    out = df.crossJoin(F.broadcast(_fences(df, columns, k)))
    clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"high_{c}")), F.col(f"low_{c}")))
    return out.withColumns({c: clip(c) for c in columns}).select(*df.columns)


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows beyond the fences (`iqr`), or more than `threshold` standard deviations from the mean (`zscore`)."""
    if method == "iqr":
        out = df.crossJoin(F.broadcast(_fences(df, [column], threshold)))
        return out.where((F.col(column) < F.col(f"low_{column}")) | (F.col(column) > F.col(f"high_{column}"))).select(*df.columns)
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    return df.crossJoin(F.broadcast(stats)).where(F.abs(F.col(column) - F.col("_mean")) > threshold * F.col("_std")).select(*df.columns)


def band(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the band (edges[i], edges[i + 1]] that a value is in; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((x > low) & (x <= high), label).otherwise(out)
    return out


def short_address(x: Column) -> Column:
    return F.when(F.length(x) > 12, F.concat(F.substring(x, 1, 6), F.lit("..."), F.substring(x, -4, 4))).otherwise(x)


def human_number(x: Column) -> Column:
    """1.2K, 3.4M, 5.6B."""
    text = lambda d, unit: F.concat(F.format_number(x / d, 1), F.lit(unit))
    return F.when(F.abs(x) >= 1e9, text(1e9, "B")).when(F.abs(x) >= 1e6, text(1e6, "M")).when(F.abs(x) >= 1e3, text(1e3, "K")).otherwise(F.format_number(x, 1))


def interaction_features(df: DataFrame, windows: tuple[str, ...] = ("30s", "60s", "120s")) -> DataFrame:
    """Ratios of neighbouring windows' volumes and counts, volume a trade and a trader, squares of imbalances."""
    tiny, out = 1e-10, {}
    for a, b in zip(windows, windows[1:], strict=False):
        out[f"volume_ratio_{a}_{b}"] = F.col(f"total_volume_{a}") / (F.col(f"total_volume_{b}") + tiny)
        out[f"txn_ratio_{a}_{b}"] = F.col(f"total_txns_{a}") / (F.col(f"total_txns_{b}") + tiny)
    for w in windows:
        out[f"volume_per_txn_{w}"] = F.col(f"total_volume_{w}") / (F.col(f"total_txns_{w}") + tiny)
        out[f"volume_imbalance_sq_{w}"] = F.col(f"volume_imbalance_{w}") * F.col(f"volume_imbalance_{w}")
    return df.withColumns(out)


# summaries


def profile_table(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, value, rows, nth): the n commonest values of each column, ties by value."""
    counts = union_sources(*(df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("rows")).select(F.lit(c).alias("column"), "value", "rows") for c in columns))
    order = Window.partitionBy("column").orderBy(F.desc("rows"), "value")
    return counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def table_ranges(df: DataFrame, times: list[str], others: list[str]) -> DataFrame:
    """(column, rows, known, first, last, days, distinct_values): of each column how many rows have a value, the least and the
    greatest as text (of times their dates), and how many distinct ones; of times also how many days they fall on. Values are
    grouped before they are counted, so no task holds a column's distinct values."""
    dated = lambda c: F.date_format(F.to_date(c), "yyyy-MM-dd")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (dated(c) if c in times else F.lit(None).cast("string")).alias("day")) for c in (*times, *others)))
    values = df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.day", "x.value").agg(F.count("*").alias("n"))
    days = values.groupBy("column", "day").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.count("value").alias("distinct_values"))
    # least and greatest by the column's own order, not as text
    ends = df.agg(*(f(dated(c) if c in times else F.col(c)).cast("string").alias(f"{name}_{c}") for c in (*times, *others) for name, f in (("first", F.min), ("last", F.max))))
    ends = ends.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"first_{c}").alias("first"), F.col(f"last_{c}").alias("last")) for c in (*times, *others)))).alias("x")).select("x.*")
    whole = days.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.count("day").alias("days"), F.sum("distinct_values").alias("distinct_values"))
    out = whole.join(F.broadcast(ends), "column")
    return out.select("column", "rows", "known", "first", "last", F.when(F.col("column").isin(times), F.col("days")).alias("days"), "distinct_values")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, corr) of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(pair_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("row")).select("row.*")


def compare_log(df: DataFrame, metrics: list[str], success: str) -> DataFrame:
    """(metric, raw_corr, log_corr): how metrics and their log1p go with a measure of success."""
    one = df.agg(*(pair_corr(m, success).alias(f"r{i}") for i, m in enumerate(metrics)), *(pair_corr(F.log1p(m), success).alias(f"l{i}") for i, m in enumerate(metrics)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"r{i}").alias("raw_corr"), F.col(f"l{i}").alias("log_corr")) for i, m in enumerate(metrics)))
    return one.select(F.explode(rows).alias("row")).select("row.*")


def result_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: mean, median, best and worst with their keys, share above 0."""
    return df.agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("best"), F.max_by(key, F.struct(value, key)).alias("best_key"),
        F.min(value).alias("worst"), F.min_by(key, F.struct(value, key)).alias("worst_key"), (F.count_if(F.col(value) > 0) / F.count("*")).alias("share_profitable"),
    )


def coin_sample_summary(samples: DataFrame, n: int) -> DataFrame:
    """The n coins with most transactions over their samples."""
    rows = samples.groupBy("coin_id").agg(F.sum("total_transactions").alias("transactions"), F.count("*").alias("samples"))
    return top_n(rows, [F.desc("transactions"), F.col("coin_id")], n)
