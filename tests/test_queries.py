"""Every query has a stable schema on the smallest data and, where it has SQL, its rows."""

import glob
import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")


def canon(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v) else repr(v.item() if hasattr(v, "item") else v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(entry.core.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ctx", "next", "prob", "rank"]
