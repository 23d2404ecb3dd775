"""Moves that turn back, quarters against a baseline, positions that don't overlap, and tests of series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.operators.places import numbered, overlapped, own, piece


def overreaction(bars: DataFrame, move: float = 0.02, within: int = 5, around: int = 5) -> DataFrame:
    """By symbol: bars that move by more than `move`, how many turn back by half of it within some bars, the mean of the
    next bar's move back, and the mean ratio of the deviation of returns after to that before."""
    rows = overlapped(numbered(bars, "symbol", "us", ["us"]), around + 1, max(within, around))
    w = piece("symbol")
    rows = rows.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    ahead = w.rowsBetween(1, within)
    spread = lambda a, b: F.when(F.count("r").over(w.rowsBetween(a, b)) == around, F.stddev_samp("r").over(w.rowsBetween(a, b)))
    rows = rows.withColumns({"__low": F.min("r").over(ahead), "__high": F.max("r").over(ahead), "__next": F.lead("r").over(w), "__before": spread(-around, -1), "__after": spread(1, around)})
    moved = own(rows).where(F.abs("r") > move)
    back = F.when(F.col("r") > 0, F.col("__low") <= -move / 2).otherwise(F.col("__high") >= move / 2)
    return moved.groupBy("symbol").agg(F.count("*").alias("moves"), F.count_if(back).alias("turned"), F.avg(F.when(F.col("r") > 0, -F.col("__next")).otherwise(F.col("__next"))).alias("mean_back"), F.avg(F.try_divide("__after", "__before")).alias("volatility_ratio"))


def quarterly_compare(daily: DataFrame, returns: Sequence[str], baseline: str) -> DataFrame:
    """(symbol, strategy, quarters, better_share, mean_return): each strategy's return from a quarter's first day to its
    last, against the baseline's. `daily` has a row a symbol and `day` since 1970; null returns count as none."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0.0)))
    grew = lambda c: F.expm1(F.sum(log(c)) - F.min_by(log(c), F.col("day")))
    quarters = daily.groupBy("symbol", F.year(date).alias("year"), F.quarter(date).alias("quarter")).agg(*[F.round(grew(c), 9).alias(c) for c in {*returns, baseline}])
    rows = quarters.select("symbol", F.col(baseline).alias("__base"), F.explode(F.array(*[F.struct(F.lit(c).alias("strategy"), F.col(c).alias("ret")) for c in returns])).alias("x"))
    return rows.groupBy("symbol", "x.strategy").agg(F.count("*").alias("quarters"), F.avg((F.col("x.ret") > F.col("__base")).cast("int")).alias("better_share"), F.avg("x.ret").alias("mean_return"))


def annotate_positions(bars: DataFrame, amount: float = 100.0, hold: int = 3) -> DataFrame:
    """Add can_execute_buy, can_execute_sell and coin_size to bars with `signal`: a signal without an open position buys
    for `amount` where the next bar has the volume and trades below its open; after `hold` bars the position goes at the
    first bar that takes it, and the bar before that one says sell. What is open decides what may open, so
    a symbol's bars are one group, in order; symbols are apart."""
    out = bars.select("symbol", "us", "open", "low", "volume", "signal").schema
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", can_execute_buy int, can_execute_sell int, coin_size double"

    def annotate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("us", kind="stable").reset_index(drop=True)
        opens, lows, volumes, signals = (rows[c].to_numpy() for c in ("open", "low", "volume", "signal"))
        n = len(rows)
        buy, sell, size = np.zeros(n, "int32"), np.zeros(n, "int32"), np.zeros(n)
        at = 0
        while at < n:
            nxt = at + 1
            if not (signals[at] == 1 and nxt < n and volumes[nxt] >= amount and lows[nxt] < opens[nxt] and opens[nxt] > 0):
                at = nxt
                continue
            buy[at], coins = 1, amount / opens[nxt]
            end = next((j for j in range(at + hold + 1, n) if volumes[j] >= coins * opens[j]), n)
            size[at:end] = coins
            if end < n:
                sell[end - 1] = 1
            at = end + 1
        return rows.assign(can_execute_buy=buy, can_execute_sell=sell, coin_size=size)

    return bars.select(*out.names).groupBy("symbol").applyInPandas(annotate, kept)


def dickey_fuller(rows: DataFrame, by: str, at: str, value: str, lags: int = 1) -> DataFrame:
    """(by, n, coefficient, statistic, stationary) of the augmented test with a constant: the change on the value before
    and `lags` changes before. Spark sums the products of the regression's columns over all rows; what is solved is one
    small matrix a group. stationary is the statistic under the 5 % value -2.86; null where the matrix has no inverse."""
    made = overlapped(numbered(rows.where(F.col(value).isNotNull()).select(by, at, F.col(value).cast("double").alias("y")), by, at, [at]), lags + 1)
    w = piece(by)
    made = made.withColumn("d", F.col("y") - F.lag("y").over(w))
    terms = {"t0": F.lit(1.0), "t1": F.lag("y").over(w), **{f"t{i + 1}": F.lag("d", i).over(w) for i in range(1, lags + 1)}}
    width = len(terms)
    made = own(made.withColumns(terms)).where(" and ".join(f"t{i} is not null" for i in range(width)) + " and d is not null")
    names = [f"t{i}" for i in range(width)] + ["d"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = made.groupBy(by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("s"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, n, s in zip(part[by], part["n"], part["s"]):
                gram = np.zeros((width + 1, width + 1))
                gram[np.triu_indices(width + 1)] = s
                gram = gram + np.triu(gram, 1).T
                x, xy, yy = gram[:width, :width], gram[:width, width], gram[width, width]
                if n <= width or np.linalg.matrix_rank(x) < width:
                    out.append((key, n, None, None, None))
                    continue
                inverse = np.linalg.inv(x)
                b = inverse @ xy
                error = math.sqrt(max((yy - b @ xy) / (n - width), 0.0) * inverse[1, 1])
                t = b[1] / error if error else None
                out.append((key, n, b[1], t, None if t is None else bool(t < -2.86)))
            yield pd.DataFrame(out, columns=[by, "n", "coefficient", "statistic", "stationary"])

    return sums.mapInPandas(solve, f"{by} {rows.schema[by].dataType.simpleString()}, n bigint, coefficient double, statistic double, stationary boolean")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    value, tail = 1.0, 1.0
    for m in range(400, 0, -1):  # from the innermost term outwards
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + even / (1 + odd / tail)
    value = 1 - (a + b) * x / (a + 1) / tail
    return min(max(front / value, 0.0), 1.0)


def gamma_rest(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function: one less its series, or its continued fraction where the tail is small."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x <= a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(max(1 - total * front, 0.0), 1.0)
    tail = x + 801 - a
    for m in range(400, 0, -1):  # from the innermost term outwards
        tail = x + 2 * m - 1 - a - m * (m - a) / tail
    return min(front / tail, 1.0)


def p_values(stats: DataFrame, kind: str, value: Column, freedom: Column) -> DataFrame:
    """Add p: two-sided for t, of a correlation r with `freedom` degrees (n - 2), or the upper tail of chi2. Null where
    either is null or no degrees are left. For tables of results, a row a test."""

    def p_of(v: float, df: float) -> float | None:
        if v is None or df is None or math.isnan(v) or math.isnan(df) or df <= 0:
            return None
        if kind == "chi2":
            return gamma_rest(df / 2, v / 2)
        t2 = v * v if kind == "t" else df * v * v / max(1 - v * v, 1e-300)
        return beta_share(df / 2, 0.5, df / (df + t2))

    @F.pandas_udf("double")
    def p(v: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([p_of(a, b) for a, b in zip(v, df)], dtype="float64")

    return stats.withColumn("p", p(value.cast("double"), freedom.cast("double")))
