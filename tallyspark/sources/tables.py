"""Append-only parquet tables in a folder that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for a table: under ``spark.checkpoint.dir`` where it is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/tallyspark"
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own, so that what reads it several times does not compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
