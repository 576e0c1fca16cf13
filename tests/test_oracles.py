"""Every registered query with SQL gives DuckDB's rows at the smallest size; the others run."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [q for q in entry.queries() if not re.match("op[0-9]+_", q) and q != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if v == v else None
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([str(plain(r[i])) for i in order] for r in rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        res = duck.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == table(columns, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
