"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = os.path.join(FOLDER, f)
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, bool) else str(v)


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == order
    at = [found.columns.index(c) for c in order]
    want = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert not bad, bad[:2]


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
