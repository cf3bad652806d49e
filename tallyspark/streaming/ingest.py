"""Documents as they arrive: an extension of the batch engine, with the same operators inside.

A file source names each document by its content; the same content within the
watermark is one document; every micro-batch is appended with its batch id, and
a batch that is run again replaces its own folder, so a restart adds nothing
twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.layouts import parse_layouts

WATERMARK = "4 hours"


def arriving(spark: SparkSession, folder: str, watermark: str = WATERMARK) -> DataFrame:
    """(document_id, json, received_at) of new layout files, each content once within the watermark."""
    raw = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    rows = raw.select(F.sha2(F.col("value").cast("binary"), 256).alias("document_id"), F.col("value").alias("json"), F.current_timestamp().alias("received_at"))
    return rows.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["document_id"])


def write_batch(folder: str):
    """A ``foreachBatch`` sink: the words of a batch's documents, idempotent by batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        words = parse_layouts(batch.select(F.col("document_id").alias("doc"), "json"))
        words.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Read what is there now and stop; run it again for what has come since."""
    return arriving(spark, source).writeStream.foreachBatch(write_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """(start, event_type, n): tumbling counts of a stream with (ts, event_type); late rows beyond the watermark are left out."""
    per = events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n")
