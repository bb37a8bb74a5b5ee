"""Every rule query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from rulequarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def frame(df):
    names = sorted(df.columns)
    df = df[names].astype(object)
    return df.where(df.notna(), None).astype(str).sort_values(names).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got).equals(frame(want))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run_and_repeat(spark, name):
    first = registry.QUERIES[name](spark, SF).toPandas()
    assert len(first) > 0
    if "sketch" not in name:
        assert frame(first).equals(frame(registry.QUERIES[name](spark, SF).toPandas()))
