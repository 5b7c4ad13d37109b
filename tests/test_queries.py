import os

import duckdb
import pytest

import __spark_entry__
from docmeter import queries as core


def _duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, sf, name):
    got = core.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = _duck(sf).execute(f"SELECT {', '.join(columns)} FROM ({core.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
