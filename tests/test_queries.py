"""Every registered graph query against its SQL, run by DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from cohesia.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, compare, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.SQL:
        assert compare(found) == compare(duck.execute(catalogue.SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1220
    assert set(entry.oracle_sql()) <= set(entry.queries())
