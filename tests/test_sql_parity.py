"""Queries with a SQL statement give the same rows in DuckDB."""

import importlib
import math
import os

import duckdb
import pytest

MODULES = [importlib.import_module(f"wayfold.plans.{m}") for m in ("values", "places", "text", "search_space", "search", "features")]
CASES = [(n, m) for m in MODULES for n in m.SQL]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(data):
    if not os.path.isdir(data):
        pytest.skip("no test data")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_same_rows(spark, data, duck, name, module):
    df = module.QUERIES[name](spark, data)
    r = duck.execute(module.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())
    assert sorted(repr(tuple(map(plain, row))) for row in df.collect()) == want
