"""Every registered query against its SQL in DuckDB over the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())


def test_flagship_and_names():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
