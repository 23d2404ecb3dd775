"""Queries that have SQL, against it."""

import duckdb
import pytest

from tradeframe.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    want = [dict(zip([d[0] for d in found.description], r)) for r in found.fetchall()]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    key = lambda r: str([r[c] for c in columns])
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(want, key=key) != []
