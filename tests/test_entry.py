"""The driver contract: every query runs, and those with SQL agree with DuckDB."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = sorted(entry.CORE_QUERIES)


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else str(v)


def _rows(frame, columns):
    return sorted(repr([_plain(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    frame = got.toPandas()
    sql = entry.CORE_ORACLES.get(name)
    if sql is None:
        assert len(frame)
        return
    want = duck.sql(sql).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert _rows(frame, columns) == _rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_llm():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "glossaflow", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "glossaflow.llm" not in f.read(), path
    assert set(entry.queries()) >= set(CORE)
    if importlib.util.find_spec("glossaflow.llm") is None:
        assert set(entry.queries()) == set(CORE)
