"""The queries that SQL can express give DuckDB's rows on whole tables of the smallest scale."""

import os

import duckdb
import pytest

from corpusloom.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(tuple(r[c] for c in names) for r in frame.collect()) == sorted(result.fetchall())
