"""Every registered query against its SQL oracle (DuckDB) on the small
test data: row count, column names and order-insensitive values."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

VIEWS = ("region nation customer supplier part orders lineitem events documents "
         "embeddings pages benchmark labels conversations").split()

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        p = f"{SF_SMALL}/{v}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {v} as select * from read_parquet('{p}')")
    return con


# Spark type -> DuckDB type name, for the schema comparison
TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE",
              "smallint": "SMALLINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert dtypes[f.name] == TYPE_NAMES.get(t, t.upper()), (f.name, t, dtypes[f.name])
    assert len(srows) == len(drows)
    assert _canon(df.columns, srows) == _canon(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["StoreCode", "InvoiceCount", "SoldQuantity", "TotalSales"]
