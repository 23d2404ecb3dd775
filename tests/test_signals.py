"""Operators of signals that have no query of their own."""

from tradeframe.operators.signals import pick_threshold

SCHEMA = "percent int, precision double, recall double, f1 double, signal_rate double"


def test_pick_threshold(spark):
    sweep = spark.createDataFrame([(10, 0.5, 0.9, 0.64, 0.5), (20, 0.7, 0.6, 0.64, 0.12), (30, 0.9, 0.3, 0.45, 0.06), (40, None, 0.0, None, 0.0)], SCHEMA)
    assert tuple(pick_threshold(sweep).first()) == (10, 20, 30)
    assert tuple(pick_threshold(sweep.limit(0)).first()) == (None, None, None)
