"""Unit roots against a plain regression, tails against known values."""

import math

import numpy as np
import pytest

from tradeframe.operators.reversal import gamma_rest
from tradeframe.operators.unit_root import augmented_dickey_fuller, critical, p_of_tau


def plain(y, most=10):
    """(rows, lag, statistic) by least squares on matrices made whole."""
    d = np.diff(y)

    def fitted(lag, skip):
        rows = range(skip, len(d))
        x = np.array([[1.0, y[t], *(d[t - i] for i in range(1, lag + 1))] for t in rows])
        v = d[skip:]
        b, *_ = np.linalg.lstsq(x, v, rcond=None)
        rest = float(((v - x @ b) ** 2).sum())
        n = len(v)
        aic = n * (math.log(2 * math.pi) + math.log(rest / n) + 1) + 2 * (lag + 2)
        return n, b[1] / math.sqrt(rest / (n - lag - 2) * np.linalg.inv(x.T @ x)[1, 1]), aic

    aics = [fitted(lag, most)[2] for lag in range(most + 1)]
    lag = int(np.argmin(aics))
    n, t, _ = fitted(lag, lag)
    return n, lag, t, aics[lag]


def test_lag_statistic_and_p(spark):
    draw = np.random.default_rng(4)
    noise = draw.normal(size=700)
    walk = 1000 + np.cumsum(noise[:400])
    back, wavy = np.zeros(700), np.zeros(300)
    for i in range(1, 700):
        back[i] = 0.5 * back[i - 1] + noise[i]
    for i in range(3, 300):
        wavy[i] = 0.4 * wavy[i - 1] - 0.3 * wavy[i - 3] + noise[i]
    made = {"walk": walk, "back": back, "wavy": wavy, "short": noise[:5], "flat": np.ones(50)}
    rows = [(k, i * 7_000_000_000, float(v)) for k, ys in made.items() for i, v in enumerate(ys)] + [("walk", 5, None), (None, 6, 1.0)]
    got = {r.k: r for r in augmented_dickey_fuller(spark.createDataFrame(rows, "k string, us long, v double").repartition(5), "k", "us", "v").collect()}
    for k in ("walk", "back", "wavy"):
        n, lag, t, aic = plain(made[k])
        assert (got[k].n, got[k].lag) == (n, lag)
        assert got[k].statistic == pytest.approx(t, rel=1e-8) and got[k].aic == pytest.approx(aic, rel=1e-8)
    assert got["back"].stationary and got["wavy"].stationary and not got["walk"].stationary
    assert got["wavy"].lag >= 2
    assert got["short"].statistic is None and got["flat"].stationary is None and len(got) == 5


def test_trim(spark):
    draw = np.random.default_rng(5)
    y = draw.normal(size=300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, us long, v double")
    low, high = np.quantile(y, [0.05, 0.9])
    n, lag, t, _ = plain(y[(y > low) & (y < high)], 3)
    got = augmented_dickey_fuller(df, "k", "us", "v", 3, (0.05, 0.9)).first()
    assert (got.n, got.lag) == (n, lag) and got.statistic == pytest.approx(t, rel=1e-8)


def test_response_surfaces():
    """Published points: the statistic at a critical value has that p, to the surfaces' own precision."""
    for name, p in (("critical_1", 0.01), ("critical_5", 0.05), ("critical_10", 0.1)):
        assert p_of_tau(critical(10**6)[name]) == pytest.approx(p, rel=0.03)
    assert critical(100)["critical_5"] == pytest.approx(-2.8909, abs=1e-3)
    assert p_of_tau(3.0) == 1.0 and p_of_tau(-20.0) == 0.0 and p_of_tau(-1.6) == pytest.approx(p_of_tau(-1.62), abs=0.02)


def test_far_tails():
    for x in (1.5, 3.0, 40.0, 500.0, 1400.0):
        assert gamma_rest(1.0, x) == pytest.approx(math.exp(-x), rel=1e-12)
        assert gamma_rest(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-10)
    assert gamma_rest(30.0, 25.0) == pytest.approx(sum(math.exp(-25 + k * math.log(25) - math.lgamma(k + 1)) for k in range(30)), rel=1e-10)
