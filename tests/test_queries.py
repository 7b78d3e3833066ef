"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from stimfuse import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x + 0.0, 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x if not hasattr(x, "item") else plain(x.item())


def close(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert all(map(close, a, b)), next((x, y) for x, y in zip(a, b, strict=True) if not close(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
