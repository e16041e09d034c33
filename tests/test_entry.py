from __future__ import annotations

import importlib
import sys

import duckdb
import pytest
from paths import SMALL

import __spark_entry__ as entries

TABLES = "nodes pv_events node_deletions job_hashes applications otel_records field_mappings orders lineitem events documents".split()


def test_names_agree():
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_entry(spark):
    assert entries.entry(spark).limit(1).count() == 1


def test_without_the_text_operators(monkeypatch):
    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("weftspan.llm")]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "weftspan.llm", None)
        fresh = importlib.reload(entries)
        names = set(fresh.queries())
        assert "p5_found" in names and not any(n.startswith(("p6", "p7", "p8")) for n in names)
    importlib.reload(entries)


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.execute(entries.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == columns
    assert sorted((tuple(_plain(r[at[c]]) for c in columns) for r in rel.fetchall()), key=str) == got
