"""Series in small pieces give what they give whole; ranks against plain Python."""

import random

import numpy as np
import pytest

from tradeframe import catalog
from tradeframe.catalog_serial import SCALES, hourly
from tradeframe.operators import serial

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("make", [
    lambda s, size: serial.mean_reversion_by_scale(hourly(s, SF), (3600, 86_400), size=size),
    lambda s, size: serial.natural_scales(catalog.pairs(s, SF), SCALES, size=size),
    lambda s, size: serial.rolling_percent_rank(hourly(s, SF).select("symbol", "us", "volume"), "symbol", "us", "volume", 9, size=size),
    lambda s, size: serial.volume_entries(hourly(s, SF), 5, size=size),
])
def test_small_pieces(spark, make):
    whole = rows_of(make(spark, 100_000))
    assert whole != [] and rows_of(make(spark, 12)) == whole


def test_percent_ranks():
    draw = random.Random(1)
    values = np.array([draw.choice([1.0, 2.0, 2.5, draw.random()]) for _ in range(500)])
    values[100] = np.nan
    got = serial.percent_ranks(values, 7)
    for i in range(500):
        frame = values[max(i - 6, 0) : i + 1]
        if len(frame) < 7 or np.isnan(frame).any():
            assert np.isnan(got[i])
        else:
            assert got[i] == pytest.approx(((frame < frame[-1]).sum() + ((frame == frame[-1]).sum() + 1) / 2) / 7 * 100)
    assert np.isnan(serial.percent_ranks(values[:3], 7)).all()
