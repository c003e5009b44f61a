"""Every core query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from feuillet.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    plain = lambda x: "null" if x is None or x is pd.NaT or x != x else str(pd.Timestamp(x).tz_localize(None)) if isinstance(x, pd.Timestamp) else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(plain(x) for x in r) for r in df.astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
