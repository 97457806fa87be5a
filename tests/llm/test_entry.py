"""The operators' registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from siftlake.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def rows(df: pd.DataFrame):
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x.tolist() if hasattr(x, "tolist") else x
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_covers_its_table(spark, name):
    table, key = ("conversations", "conv_id") if name.startswith("op6_") else ("documents", "doc_id")
    out = catalogue.queries()[name](spark, SF)
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().collect()}
    assert {r[0] for r in out.select(key).distinct().collect()} == want


def test_pipeline_is_registered():
    assert "pipeline" in __spark_entry__.queries()
