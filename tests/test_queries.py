"""Each document query against its DuckDB SQL, row by row."""

import os

import duckdb
import pytest

from velloom.plans import queries

DATA = os.environ.get("VELLOOM_DATA", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events", "benchmark"):
        db.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    want = db.sql(SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    order = [want.columns.index(n) for n in names]
    clean = lambda r: tuple(float(x) if isinstance(x, float) else x for x in r)
    assert sorted((clean(r[n] for n in names) for r in rows), key=str) == sorted((clean(r[i] for i in order) for r in want.fetchall()), key=str)
