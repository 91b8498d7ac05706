"""The driver contract over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from corpuswash.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_every_library_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLES) and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    tidy = lambda row: repr([round(v, 9) if isinstance(v, float) else v for v in row])
    assert sorted(tidy([r[c] for c in columns]) for r in got.collect()) == sorted(tidy([r[i] for i in place]) for r in want.fetchall())
