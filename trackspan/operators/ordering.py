"""Positions in an order that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage


def place_within(df: DataFrame, key: str, order: str, name: str = "place") -> DataFrame:
    """``df``, staged, with the position of each row among those of its ``key``, from 0 by ``order``.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in many tasks. A position is the place
    within the task plus the rows of the key in the tasks before; the only window over a whole key has a row per task.
    """
    dealt = stage(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "dealt")
    within = F.row_number().over(Window.partitionBy("_part", key).orderBy(order)) - 1
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part", key).agg(F.count("*").alias("_n")).select(
        "_part", key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_within", within).join(starts, ["_part", key])
    return stage(placed.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_part", "_within", "_start"), "placed")
