"""Positions, unit roots and p-values against plain numpy and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeframe.operators import reversal


def test_positions_do_not_overlap(spark):
    #            buy   next           exit of hold 2 needs volume >= coins * open
    rows = [("a", i, 10.0, 9.0, v, s) for i, (v, s) in enumerate([(500.0, 1), (500.0, 1), (500.0, 0), (1.0, 0), (500.0, 0), (500.0, 1), (500.0, 0)])]
    rows += [("b", 0, 10.0, 9.0, 5.0, 1), ("b", 1, 10.0, 10.0, 500.0, 1), ("b", 2, 10.0, 9.0, 500.0, 0)]
    df = spark.createDataFrame(rows, "symbol string, us long, open double, low double, volume double, signal int")
    got = reversal.annotate_positions(df, 100.0, 2).orderBy("symbol", "us").collect()
    a = [r for r in got if r.symbol == "a"]
    assert [r.can_execute_buy for r in a] == [1, 0, 0, 0, 0, 1, 0]
    assert [r.can_execute_sell for r in a] == [0, 0, 0, 1, 0, 0, 0]
    assert [r.coin_size for r in a] == [10.0, 10.0, 10.0, 10.0, 0.0, 10.0, 10.0]
    assert [r.can_execute_buy for r in got if r.symbol == "b"] == [0, 1, 0]


def test_dickey_fuller_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    rows = [("walk", i, float(v)) for i, v in enumerate(walk)] + [("noise", i, float(v)) for i, v in enumerate(noise)] + [("flat", i, 1.0) for i in range(20)] + [("short", 0, 1.0)]
    got = {r.g: r for r in reversal.dickey_fuller(spark.createDataFrame(rows, "g string, at long, v double"), "g", "at", "v", 2).collect()}
    for name, y in (("walk", walk), ("noise", noise)):
        d = np.diff(y)
        x = np.column_stack([np.ones(len(d) - 2), y[2:-1], d[1:-1], d[:-2]])
        b, *_ = np.linalg.lstsq(x, d[2:], rcond=None)
        s2 = ((d[2:] - x @ b) ** 2).sum() / (len(x) - 4)
        assert np.isclose(got[name].statistic, b[1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]))
    assert got["noise"].stationary and not got["walk"].stationary
    assert got["flat"].statistic is None and "short" not in got


@pytest.mark.parametrize("kind,value,freedom,want", [("t", 2.228138852, 10, 0.05), ("t", 0.0, 5, 1.0), ("t", -1.959964, 1e6, 0.05), ("chi2", 3.841458821, 1, 0.05), ("chi2", 18.30703805, 10, 0.05), ("r", 0.5, 18, None)])
def test_p_values(spark, kind, value, freedom, want):
    df = spark.createDataFrame([(value, float(freedom)), (None, 1.0), (1.0, 0.0)], "v double, f double")
    got = [r.p for r in reversal.p_values(df, kind, F.col("v"), F.col("f")).collect()]
    if want is None:  # the density of t over its tails, summed
        t, x = value * np.sqrt(freedom / (1 - value * value)), np.linspace(0, 1, 2_000_001)[1:-1]
        at = t + x / (1 - x)
        density = (1 + at * at / freedom) ** (-(freedom + 1) / 2)
        whole = (1 + (x / (1 - x)) ** 2 / freedom) ** (-(freedom + 1) / 2)
        want = (density / (1 - x) ** 2).sum() / (whole / (1 - x) ** 2).sum()
    assert np.isclose(got[0], want, atol=2e-6) and got[1:] == [None, None]
