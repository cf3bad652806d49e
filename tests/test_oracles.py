"""Every registered query against its oracle SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    places = [found.columns.index(c) for c in df.columns]
    expected = sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == expected
