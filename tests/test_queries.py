"""Every query with SQL returns the SQL's rows; the driver's entry points work, also without the optional subpackage."""

import importlib
import sys

import duckdb
import pytest

from graphloom.catalog import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match_sql(spark, duck, name):
    df, r = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
    at = [r.columns.index(c) for c in columns]
    assert ours == sorted(repr([plain(row[i]) for i in at]) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("graphloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert "gr_degree" in e.queries() and "pipeline" not in e.queries()
    sys.modules.pop("__spark_entry__", None)
