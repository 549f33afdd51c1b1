"""Each query with SQL gives the rows that DuckDB gives; the others give rows."""

import os

import duckdb
import pytest

from provenant.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
