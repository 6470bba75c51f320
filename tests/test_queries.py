"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from panelspark.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    b = sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:5]
