"""Every query with SQL against DuckDB, every other one run, on the smallest data."""

import importlib
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = {name: q for module in entry.CORE for name, q in importlib.import_module(module).QUERIES.items()}
SQL = {name: q for module in entry.CORE for name, q in importlib.import_module(module).ORACLE.items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 5) if isinstance(v, float) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    assert rows(CORE[name](spark, data).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, data, name):
    df = CORE[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(CORE) == sum(len(importlib.import_module(m).QUERIES) for m in entry.CORE)


def test_the_core_does_not_know_the_llm_package():
    for f in Path(entry.__file__).parent.glob("shroudline/**/*.py"):
        if "llm" not in f.parts:
            assert "shroudline.llm" not in f.read_text()
