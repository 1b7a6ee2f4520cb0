"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from titleweave.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def compare(spark, folder, query, sql):
    from pathlib import Path

    con = duckdb.connect()
    for path in Path(folder).iterdir():
        con.sql(f"create view {path.stem} as select * from '{path}'")
    got, want = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    as_rows = lambda f: sorted([[str(x) for x in r] for r in f[columns].astype(object).where(f[columns].notna(), None).values.tolist()])
    assert as_rows(got) == as_rows(want)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, name):
    compare(spark, small, QUERIES[name], SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
