"""Exact places in a total order over range partitions, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepsake.session import settle


def sorted_once(rows: DataFrame, purpose: str, *order: Column) -> DataFrame:
    """The rows written in total order: ``_part`` and, inside it, ``_at`` ascend with the order.

    Rows of equal keys follow each other in no particular order and may be spread over partitions.
    ``rows`` should be a written table, as the bounds of the ranges are sampled from it first.
    """
    tied = rows.withColumn("_tie", F.rand(11))
    ranged = tied.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie")
    return settle(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), purpose)


def with_places(rows: DataFrame, *by: str) -> DataFrame:
    """``sorted_once`` rows with ``pos``, counted from 0 in each group, and ``n``, the rows of the group.

    Groups have to be runs of the order. What is summed up has one row per group and partition.
    """
    runs = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(
        *by, "_part", "_first", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(*by)).alias("n"),
    )
    placed = rows.join(settle(runs, "runs"), [*by, "_part"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")
