"""The opN queries that SQL can express, against their SQL on DuckDB."""

import os

import duckdb
import pytest

from linkscope.llm import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    got, want = catalog.queries()[name](spark, DIR), con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, found: sorted(repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
