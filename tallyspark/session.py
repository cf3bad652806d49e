"""A session with the settings the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Without these results can be wrong, so every query sets them in the session it is given. A union that passes its
#: parts' partitioning on saves a shuffle, but where a part reads another's exchange Spark 4.1 lays its partitions one
#: after another all the same, and what is grouped after it comes out in several rows for a key.
NEEDED = {"spark.sql.unionOutputPartitioning": "false"}
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **NEEDED,
}


def settle(spark: SparkSession) -> None:
    for key, value in NEEDED.items():
        spark.conf.set(key, value)


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("tallyspark")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
