"""What the operators of this package share: reading, words, shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tallyspark"


#: What a Python worker holds at once: rows and bytes of one Arrow batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of this session small, so that long texts do not fill a worker's memory."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found := LOCAL_CHECKPOINTS)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder, with ``options`` of the Parquet writer, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for small results; Spark removes it when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sample_below(key: Column, fraction: float) -> Column:
    """True for about ``fraction`` of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < F.lit(int(fraction * (1 << 40)))
