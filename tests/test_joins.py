"""Queries whose joins are too large to be broadcast, as on large tables."""

import os

import duckdb
import pytest

from tallyspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def merged(spark):
    """A session as others have it, in which nothing is broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.unionOutputPartitioning": "true"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_choice_of_templates_is_the_same_on_both_sides_of_a_join(merged):
    df = registry.QUERIES["det4_extracted"](merged, SF)
    found = sorted(map(tuple, df.collect()))
    c = duckdb.connect()
    for name in ("orders", "customer"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    expected = c.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES['det4_extracted']})").fetchall()
    assert {t for _, t, *_ in found} == {"alpha/current/v1", "beta/current/v1", "gamma/current/v2"}
    assert found == sorted(expected)
