"""Named tables that are worked out once, and places in an order of a whole table."""

import random

from pyspark.sql import functions as F

from tradeframe.operators.places import ranked, running
from tradeframe.sources.written import cache_table, files_version, written


def test_cached_table_is_made_anew_when_its_source_changes(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "cache")
    spark.range(5).write.parquet(source)
    name, drawn = "cached_trades", spark.read.parquet(source).select("id", F.rand().alias("r"))
    first = files_version(spark.read.parquet(source))
    before = {r.r for r in cache_table(drawn, name, folder, first).collect()}
    assert {r.r for r in cache_table(drawn, name, folder, first).collect()} == before
    spark.range(5, 9).write.mode("append").parquet(source)
    second = files_version(spark.read.parquet(source))
    assert second != first
    for version in (second, "third", "fourth"):
        spark.catalog.refreshByPath(source)
        found = cache_table(spark.read.parquet(source), name, folder, version)
        assert sorted(r.id for r in found.collect()) == list(range(9))
    kept = [p for p in (tmp_path / "cache").iterdir() if p.is_dir()]
    assert len(kept) == 1 + 2  # that of other columns, and the last two
    assert sorted(r.id for r in cache_table(spark.read.parquet(source), name, folder).collect()) == list(range(9))
    spark.sql(f"DROP TABLE {name}")


def test_ranked_numbers_hot_groups_and_ties(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot"] * 20 + ["a", "b", None]), draw.choice([None, 1, 1, 1, 1, draw.randint(0, 9)]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = ranked(df, ["g"], ["v"], total="n").collect()
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        of = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in of] == list(range(len(of))) and {r.n for r in of} == {len(of)}
        values = [(r.v is not None, r.v or 0) for r in of]
        assert values == sorted(values)
    whole = sorted(ranked(df, [], [-F.col("i")], "at").collect(), key=lambda r: r["at"])
    assert [r.i for r in whole] == list(range(3999, -1, -1))
    assert ranked(df.limit(0), ["g"], ["v"]).count() == 0
    assert written(df, "t").count() == 4000


def test_running_sums_and_greatest(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["hot"] * 9 + [None, "b"]), i, draw.choice([None, draw.randint(-9, 9)])) for i in range(900)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v long").repartition(5)
    for most, of in ((False, lambda xs: sum(xs)), (True, lambda xs: max(xs, default=None))):
        got = running(df, ["g"], ["i"], {"v": "before"}, {"v": "all"}, most=most).collect()
        assert len(got) == 900
        for r in got:
            known = [(i, v) for g, i, v in rows if g == r.g and v is not None]
            assert r.before == of([v for i, v in known if i < r.i]) and r["all"] == of([v for _, v in known])
