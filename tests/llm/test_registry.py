"""Queries of the llm folder against their SQL."""

import glob
import os

import pytest

from tracefold.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    found = con.execute(SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(repr, found.fetchall()))
