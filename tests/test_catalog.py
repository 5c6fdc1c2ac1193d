"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import datetime

import duckdb
import pytest

from linkscope.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted(([columns[i] for i in order], [repr(plain(r[i])) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_entry_module():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(catalog.queries()) <= names
    assert set(e.oracle_sql()) <= names
