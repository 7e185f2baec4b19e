"""Every registered query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chronofact.plans.registry import ORACLES, QUERIES
from chronofact.plans.views import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.5f}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (p.replace(".", "").replace("-", "").isdigit() and abs(float(p) - float(q)) < 1e-4) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["item_id", "fact_id", "score", "rank"]


def test_registry_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 150
