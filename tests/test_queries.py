"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from vellumspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(df):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return "none"
        return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(value(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["docid", "collection_id", "language", "rank"]
