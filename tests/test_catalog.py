"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from corpusloom import catalog


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    rows = df.collect()
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        places = [names.index(c) for c in df.columns]
        assert sorted(repr(tuple(x[i] for i in places)) for x in found.fetchall()) == sorted(repr(tuple(x)) for x in rows)
    else:
        assert rows


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
