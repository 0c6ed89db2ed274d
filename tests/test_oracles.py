"""Every query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from pagemill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    assert not (float(v) == 0 and math.copysign(1, float(v)) < 0), "a negative zero hashes differently"
    return f"{float(v):.9g}"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    want = con.execute(registry.SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(x or "" for x in r)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)
    assert a == b
    assert a


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
