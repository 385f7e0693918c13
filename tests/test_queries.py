"""Every registered query with SQL against DuckDB on the smallest tables; the others for rows and columns."""

from __future__ import annotations

import glob
import os

import pytest

from loomspan.queries import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(df):
    df = df[sorted(df.columns)].convert_dtypes()
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_catalogue_is_whole():
    from loomspan.operators.tensor import CATALOGUE

    assert len(CATALOGUE) == 56
    names = {"OP-FILLA": "op_fill"}
    for op in CATALOGUE:
        key = names.get(op, "op_" + op[3:].lower())
        assert key in QUERIES and key in ORACLE, op


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
