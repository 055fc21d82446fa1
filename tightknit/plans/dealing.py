"""Rows dealt to tasks by the work they cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tightknit.plans.stable import stable, stable_measured


def deal(rows: DataFrame, keys: list[str], weight: Column, num_partitions: int) -> DataFrame:
    """``rows`` in ``num_partitions`` partitions of about equal weight; ``keys`` tell the rows apart.

    Keys are put in order and their weights summed up along it; partition i gets the i-th of equal stretches of the sum.
    Weights are summed within ranges, and over the ranges from one row each, so that nothing
    but keys and weights is sorted. No partition exceeds the mean by more than its heaviest row.
    """
    ranged = rows.select(*keys, weight.cast("bigint").alias("weight")).repartitionByRange(*keys)
    sized, seen = stable_measured(ranged.withColumn("p", F.spark_partition_id()), total=F.sum("weight"))
    held = sized.groupBy("p").agg(F.sum("weight").alias("held"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("p", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    along = Window.partitionBy("p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumn("within", F.sum("weight").over(along)).join(F.broadcast(before), "p")
    middle = F.col("before") + F.col("within") - F.col("weight") / 2
    part = F.least(F.floor(middle / max(seen["total"], 1) * num_partitions), F.lit(num_partitions - 1)).cast("int")
    placed = stable(summed.select(*keys, part.alias("part")))
    return rows.join(placed.hint("merge"), keys).repartitionById(num_partitions, "part").drop("part")
