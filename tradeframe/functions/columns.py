"""Column expressions of the trade operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts that count as round.
ROUND_AMOUNTS = (
    0.01, 0.05, 0.1, 0.2, 0.25, 0.5, 0.75,
    1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0,
    15.0, 20.0, 25.0, 50.0, 75.0, 100.0,
    150.0, 200.0, 250.0, 500.0, 750.0, 1000.0,
    1500.0, 2000.0, 2500.0, 5000.0, 10000.0,
)


def micros(ts: str = "block_timestamp") -> Column:
    """Microseconds since 1970 of a timestamp, with zone or without."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def size_category(amount: Column) -> Column:
    return F.when(amount >= 100, "Whale").when(amount >= 10, "Big").when(amount >= 1, "Medium").when(amount > 0, "Small").otherwise("Unknown")


def is_round_amount(amount: Column) -> Column:
    return amount.isin(*ROUND_AMOUNTS)


def rounded(*names: str) -> dict[str, Column]:
    """For withColumns: doubles to six places, as sums of doubles depend on the order of their terms."""
    return {n: F.round(n, 6) for n in names}
