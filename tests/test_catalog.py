"""Every query of the catalog against its SQL."""

import math

import duckdb
import pytest

from tradeframe import catalog

SF = "/root/testdata/sf0.01"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        out.append(tuple(None if row[i] is None or isinstance(row[i], float) and math.isnan(row[i]) else round(row[i], 5) + 0.0 if isinstance(row[i], float) else str(row[i]) for i in order))
    return sorted(out, key=str), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want, want_names = plain(want.fetchall(), names)
    got, got_names = plain([tuple(x) for x in df.collect()], df.columns)
    assert got_names == want_names
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)
