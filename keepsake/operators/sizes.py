"""Size totals and list differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COPIES_AT_ONCE = 1000


def size_total(relations: DataFrame) -> DataFrame:
    """Bytes of all tables; -1 if there is none."""
    return relations.filter(F.col("relkind") == "r").agg(
        F.coalesce(F.sum("total_bytes"), F.lit(-1).cast("bigint")).alias("total_bytes")
    )


def size_by_schema(relations: DataFrame) -> DataFrame:
    """The same per schema, with the share of the rows themselves (no indexes, no overflow storage)."""
    heap = F.col("total_bytes") - F.col("index_bytes") - F.coalesce("toast_bytes", F.lit(0))
    return relations.filter(F.col("relkind") == "r").groupBy("table_schema").agg(
        F.sum("total_bytes").alias("total_bytes"), F.sum(heap).alias("table_bytes")
    )


def config_diff(before: DataFrame, after: DataFrame, column: str = "line") -> DataFrame:
    """(change, line): lines removed from or added to a list, as often as they are; empty if equal.

    Both lists are counted in one pass: +1 for each new line, -1 for each old one.
    """
    both = before.select(F.col(column).alias("line"), F.lit(-1).alias("d")).union(
        after.select(F.col(column).alias("line"), F.lit(1).alias("d"))
    )
    net = both.groupBy("line").agg(F.sum("d").alias("d")).filter(F.col("d") != 0)
    change = F.when(F.col("d") > 0, F.lit("added")).otherwise(F.lit("removed"))
    # copies of a line come out thousand by thousand, never as one array
    step, copies = F.lit(COPIES_AT_ONCE).cast("bigint"), F.abs("d")
    starts = net.select(change.alias("change"), "line", copies.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1, step)).alias("start"))
    return starts.select("change", "line", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(step, F.col("n") - F.col("start")))).alias("copy")).drop("copy")
