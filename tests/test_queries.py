"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidelane.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canon(rows):
    return sorted(tuple("%.6g" % x if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert canon(rows) == canon(want)


def test_entry_has_sql_for_every_own_query():
    assert registry.SQL.keys() == registry.QUERIES.keys()
