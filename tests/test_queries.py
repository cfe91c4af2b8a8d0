"""Every registered query against its SQL twin, on the smallest generated tables."""

import os

import pytest

import __spark_entry__ as contract
from check import TABLES, bag
from starfold.plans import queries as registered

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="generated tables not present")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registered.PLANS))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, PATH)
    got = bag(df.columns, df.collect())
    cur = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == bag(names, cur.fetchall())
