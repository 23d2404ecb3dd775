"""The augmented Dickey-Fuller test with the lag chosen by the data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.operators.places import numbered, overlapped, own, piece, quantiles, with_cuts

# MacKinnon's response surfaces for one series and a constant, p-values of 1994 and critical values of 2010.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {
    "critical_1": (-3.43035, -6.5393, -16.786, -79.433),
    "critical_5": (-2.86154, -2.8903, -4.234, -40.040),
    "critical_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def p_of_tau(tau: float) -> float:
    """The share of the statistic's distribution below, were there a unit root."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def critical(n: int) -> dict[str, float]:
    return {name: sum(c / n**i for i, c in enumerate(cs)) for name, cs in CRITICAL.items()}


def fit(gram: np.ndarray, n: int, width: int) -> tuple[float, float] | None:
    """(t of the second term, sum of squared residuals) of the regression on the first `width` terms of a Gram matrix whose last
    row is the response; None where it has no unique solution."""
    x, xy, yy = gram[:width, :width], gram[:width, -1], gram[-1, -1]
    scale = np.sqrt(np.diag(x))
    if n <= width or not (scale > 0).all():
        return None
    x = x / np.outer(scale, scale)
    if np.linalg.matrix_rank(x, tol=1e-10) < width:
        return None
    inverse = np.linalg.inv(x)
    b = inverse @ (xy / scale)
    rest = yy - b @ (xy / scale)
    if rest <= yy * 1e-12:
        return None
    return b[1] / math.sqrt(rest / (n - width) * inverse[1, 1]), rest


def choose(gram: np.ndarray, early: list[tuple[int, np.ndarray]], n: int, most: int) -> tuple | None:
    """(rows, lag, statistic, AIC): all lags are compared over the rows that have `most`; the one of least AIC is fitted again
    over all rows that have as many."""
    best = None
    for lag in range(most + 1):
        found = fit(gram[np.r_[: lag + 2, -1]][:, np.r_[: lag + 2, -1]], n, lag + 2)
        if found:
            aic = n * (math.log(2 * math.pi) + math.log(found[1] / n) + 1) + 2 * (lag + 2)
            best = min(best or (math.inf, 0), (aic, lag))
    if best is None:
        return None
    aic, lag = best
    use = np.r_[: lag + 2, -1]
    gram, rows = gram[use][:, use].copy(), n
    for place, terms in early:
        if place > lag:
            gram += np.outer(terms[use], terms[use])
            rows += 1
    found = fit(gram, rows, lag + 2)
    return found and (rows, lag, found[0], aic)


def augmented_dickey_fuller(rows: DataFrame, by: str, at: str, value: str, max_lag: int = 10, trim: tuple[float, float] | None = None) -> DataFrame:
    """(by, n, lag, statistic, p, critical_1, critical_5, critical_10, aic, stationary) of each series: the change on a
    constant, the value before and `lag` changes before, the lag of least AIC among 0 to max_lag. p is MacKinnon's;
    stationary is p under 0.05. `trim` keeps values between two of the series' quantiles. Rows of null group, time or value
    are left out; null where a series is too short or doesn't vary.

    Spark sums one Gram matrix of all terms over each series, dealt in pieces that overlap by the lags; every lag's
    regression is a part of it. The few first rows, which have some lags only, go beside it."""
    made = rows.where(F.col(value).isNotNull() & F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, F.col(value).cast("double").alias("y"))
    if trim:
        made = with_cuts(made, quantiles(made, [by], "y", {"__low": trim[0], "__high": trim[1]}), [by]).where("y > __low and y < __high").drop("__low", "__high")
    # about the mean, which the constant takes up: sums of squares stay exact
    made = with_cuts(made, made.groupBy(by).agg(F.avg("y").alias("__mean")), [by]).withColumn("y", F.col("y") - F.col("__mean")).drop("__mean")
    made = overlapped(numbered(made, by, at, [at]), max_lag + 1)
    w = piece(by)
    made = made.withColumn("d", F.col("y") - F.lag("y").over(w))
    names = ["t0", "t1", *(f"t{i + 1}" for i in range(1, max_lag + 1)), "d"]
    made = made.withColumns({"t0": F.lit(1.0), "t1": F.lag("y").over(w), **{f"t{i + 1}": F.lag("d", i).over(w) for i in range(1, max_lag + 1)}})
    made = own(made).where("place > 0")
    full = F.col("place") > max_lag
    products = F.array(*(F.sum(F.when(full, F.col(a) * F.col(b))) for i, a in enumerate(names) for b in names[i:]))
    early = F.collect_list(F.when(~full, F.struct("place", F.array(*(F.coalesce(c, F.lit(0.0)) for c in names)).alias("terms"))))
    sums = made.groupBy(by).agg(F.count_if(full).alias("n"), products.alias("s"), early.alias("early"))
    width = len(names)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, n, s, first in zip(part[by], part["n"], part["s"], part["early"]):
                found = None
                if n > 0:
                    gram = np.zeros((width, width))
                    gram[np.triu_indices(width)] = s
                    gram = gram + np.triu(gram, 1).T
                    found = choose(gram, [(r["place"], np.asarray(r["terms"], float)) for r in first], int(n), max_lag)
                if not found:
                    out.append((key, None, None, None, None, None, None, None, None, None))
                    continue
                rows_n, lag, tau, aic = found
                p = p_of_tau(tau)
                out.append((key, rows_n, lag, tau, p, *critical(rows_n).values(), aic, p < 0.05))
            yield pd.DataFrame(out, columns=[by, "n", "lag", "statistic", "p", *CRITICAL, "aic", "stationary"]).astype({"n": "Int64", "lag": "Int64", "stationary": "boolean"})

    kind = rows.schema[by].dataType.simpleString()
    return sums.mapInPandas(solve, f"{by} {kind}, n bigint, lag bigint, statistic double, p double, critical_1 double, critical_5 double, critical_10 double, aic double, stationary boolean")
