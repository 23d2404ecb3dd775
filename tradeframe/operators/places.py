"""Rows of a group by their place in it, dealt so that no group is one task; exact quantiles from counted values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tradeframe.sources.written import written

DAY = 86_400_000_000


def numbered(rows: DataFrame, by: str, at: str, order: Sequence[str], bucket_us: int = DAY) -> DataFrame:
    """Add `place`: a row's number in its group, from 0. Rows are ordered within stretches of time; a table of a row a
    stretch tells how many come before. Rows of null group or time are left out."""
    rows = rows.withColumn("__stretch", F.floor(F.col(at) / bucket_us))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(by, "__stretch").agg(F.count("*").alias("__n")).select(by, "__stretch", F.coalesce(before, F.lit(0)).alias("__before"))
    near = F.row_number().over(Window.partitionBy(by, "__stretch").orderBy(*order))
    return rows.withColumn("__near", near).join(counts, [by, "__stretch"]).withColumn("place", F.col("__before") + F.col("__near") - 1).drop("__near", "__before", "__stretch")


def overlapped(rows: DataFrame, behind: int, ahead: int = 0, size: int = 100_000) -> DataFrame:
    """Deal numbered rows into pieces of `size` places; each also gets the rows `behind` and `ahead` of it, for frames
    that reach so far. `__own` tells a piece's own rows."""
    if max(behind, ahead) > size:
        raise ValueError("a frame is longer than a piece")
    own, within = F.floor(F.col("place") / size), F.col("place") % size
    pieces = F.array_compact(F.array(own, F.when(within >= size - behind, own + 1), F.when((within < ahead) & (own > 0), own - 1)))
    return rows.withColumn("__piece", F.explode(pieces)).withColumn("__own", F.col("__piece") == own)


def piece(by: str) -> WindowSpec:
    return Window.partitionBy(by, "__piece").orderBy("place")


def own(rows: DataFrame) -> DataFrame:
    return rows.where("__own").drop("__own", "__piece")


def pair_corr(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson's r of the rows that have both; null where either doesn't vary. Not F.corr: that divides by the deviations
    before any test of them, an error where one is 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    spread = at(F.stddev_pop(x)) * at(F.stddev_pop(y))
    varies = spread > 0
    if over is None:  # parts of equal values, put together, have a deviation about 1e-17
        varies &= (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.try_divide(at(F.covar_pop(x, y)), F.when(varies, spread))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of a value by group, a column for each name. Equal values are counted before any are
    ordered, and the order is sorted on disk, not held in a map. Null values don't count."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    if by:
        group = Window.partitionBy(*by)
        counted = counted.withColumns({"__upto": F.sum("__n").over(group.orderBy(value)), "__all": F.sum("__n").over(group)})
    else:  # the whole table's order is no one task's
        counted = running(counted, [], [value], {"__n": "__upto"}, {"__n": "__all"}).withColumn("__upto", F.col("__upto") + F.col("__n"))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("__upto") > place, F.col(value)))

    out = []
    for name, p in shares.items():
        spot = (F.col("__all") - 1) * F.lit(p)
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        out.append((low + (high - low) * (F.max(spot) - F.max(F.floor(spot)))).alias(name))
    return counted.groupBy(*by).agg(*out)


def with_cuts(rows: DataFrame, cuts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join each group's cuts to its rows; the table of cuts has a row a group, one row without groups."""
    if by:
        return rows.join(cuts, list(by))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(cuts.withColumn("__one", F.lit(1))), "__one").drop("__one")


def in_pieces(rows: DataFrame, by: str, at: str, work: Callable[[DataFrame, WindowSpec], DataFrame], behind: int = 0, ahead: int = 0, size: int = 100_000) -> DataFrame:
    """What `work` makes of rows and a window over a group's rows in the order of time: a frame or lag in it may reach so many
    rows behind and ahead of each row. The group's rows are dealt in pieces, so a group is not one task. Rows of null group
    or time are left out."""
    dealt = overlapped(numbered(rows, by, at, [at]), behind, ahead, max(size, behind, ahead))
    return own(work(dealt, piece(by))).drop("place")


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, str], totals: dict[str, str] | None = None, most: bool = False) -> DataFrame:
    """Add, for each column and the name it is to have, its sum over the rows before in the group, in ascending order of any
    columns; without groups, in the whole table. `totals` likewise names columns for sums over the whole group. With `most` it
    is the greatest value instead, null where there is none before. Groups and values may be null; nulls come first. Rows that
    the order doesn't tell apart follow each other in any way.

    The table is dealt by ranges of group and order, so a group that holds most rows is many tasks, as are equal values: a
    number of their own tells such rows apart. What comes before a range in its group is summed in a table of a row a
    range and group."""
    totals = totals or {}
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = rows.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order)}).withColumn("__own", F.monotonically_increasing_id())
    dealt = written(dealt.repartitionByRange(*by, *keys, "__own").withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.max if most else F.sum
    summed = lambda c, w: whole(c).over(w) if most else F.coalesce(F.sum(c).over(w), F.lit(0))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = dealt.groupBy("__range", *by).agg(*(whole(c).alias(f"__s_{c}") for c in {**sums, **totals}))
    parts = parts.select(
        F.col("__range").alias("__r"),
        *(F.col(c).alias(f"__b{i}") for i, c in enumerate(by)),
        *(summed(f"__s_{c}", earlier(group.orderBy("__range"))).alias(f"__before_{c}") for c in sums),
        *(whole(f"__s_{c}").over(group).alias(name) for c, name in totals.items()),
    )
    on = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"__b{i}"))
    near = earlier(Window.partitionBy("__range", *by).orderBy(*keys, "__own"))
    found = dealt.withColumns({f"__near_{c}": summed(c, near) for c in sums}).join(parts, on)
    both = F.greatest if most else (lambda a, b: F.col(a) + F.col(b))
    found = found.withColumns({name: both(f"__before_{c}", f"__near_{c}") for c, name in sums.items()})
    return found.drop("__own", "__range", "__r", *keys, *(f"__b{i}" for i in range(len(by))), *(f"__{part}_{c}" for c in sums for part in ("near", "before")))


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], place: str = "place", total: str | None = None) -> DataFrame:
    """Add `place`: a row's number in its group, from 0, as running() orders rows; `total` names a column for the group's
    number of rows."""
    rows = rows.withColumn("__one", F.lit(1).cast("long"))
    return running(rows, by, order, {"__one": place}, {"__one": total} if total else None).drop("__one")


def mean_ranks(rows: DataFrame, by: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """(by..., value, n, rank, all) of each value that occurs in a group: how many rows have it, their mean rank from 1, and
    the group's rows. Equal values are counted before any are ordered, so ties have one rank wherever ranges meet. Rows of
    null value are left out."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(counted, by, [value], {"n": "__before"}, {"n": "all"}).withColumn(rank, F.col("__before") + (F.col("n") + 1) / 2).drop("__before")
