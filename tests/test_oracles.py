"""Every query with SQL gives the rows that DuckDB gives, on the smallest scale; the others give some rows."""

import os

import duckdb
import pytest

import __spark_entry__
from corpusloom import queries as engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in frame.collect())
    if name not in engine.ORACLES:
        assert got
        return
    result = duck.execute(engine.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(text(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.limit(5).count() == 5


def test_imports_without_the_subpackage():
    """Nothing outside llm imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "corpusloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", path.read_text(), re.M), path
