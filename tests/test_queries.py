"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(found.columns) == sorted(want.columns)
        assert ordered(rows, found.columns) == ordered(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.columns == ["doc_id", "topic_idx", "prob", "cell"]
    assert frame.count() > 0
