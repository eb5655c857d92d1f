"""Every registered query of the engine against its DuckDB text on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import fixtures, stored  # noqa: F401 - register their queries
from lodestone.plans import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        x = float(v)
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    except (TypeError, ValueError, OverflowError):
        return str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = own.QUERIES[name](spark, DATA).toPandas(), duck.execute(own.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_gives_rows(spark, name):
    assert own.QUERIES[name](spark, DATA).count() > 0


def test_index_search_finds_nine_of_ten(spark):
    found = [r.recall for r in own.QUERIES["k1_ann_recall"](spark, DATA).collect()]
    assert sum(found) / len(found) >= 0.9
