"""Each query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from tideglass.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, FOLDER)
    theirs = duck.sql(registry.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in theirs.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
