"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {SQL[name]}")
    assert sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall()) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM want").fetchall()
    found = [tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
