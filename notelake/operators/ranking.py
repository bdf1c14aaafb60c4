"""Ranks within groups and over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, place: str = "rank") -> DataFrame:
    """The first k rows of each group with their 1-based place; the order must end with a unique key."""
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(place) <= k)


def global_rank(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """1-based places over the whole table without one task that holds it.

    Rows are range-partitioned by the order, ranked inside their partition, and offset by the number
    of rows in the partitions before.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(offsets), "__part").withColumn(place, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
