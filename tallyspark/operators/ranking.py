"""Ranks over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in the order of all rows.

    Rows are range-partitioned, ranked inside their partition, and shifted by
    the sizes of the partitions before: those sizes are one row per partition.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inside = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__part", before.alias("__before"))
    return inside.join(F.broadcast(shifts), "__part").withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")
