"""Every registered query of the graph against DuckDB, on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from graphloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)


def test_entry_without_the_training_data_part(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not any(n.startswith("op") for n in e.queries() if n[2:3].isdigit()) and "pipeline" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
