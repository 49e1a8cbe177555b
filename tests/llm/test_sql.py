"""The SQL of the training-data queries gives the rows of the queries on the same tables."""

import os

import duckdb
import pytest
from test_oracles import plain, same

from tidemark.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    found = con.sql(queries.ORACLES[name])
    shared = sorted(set(df.columns) & set(found.columns))
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in shared]
    got = sorted(([plain(r[c]) for c in shared] for r in df.collect()), key=repr)
    want = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert not bad, bad[:2]
