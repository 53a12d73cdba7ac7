"""Tables that are changed by writing their next version.

``<path>/v<number>`` is a complete version once it carries that name; the highest is the table.
A version is written beside it under a hidden name and put in place by one rename, so a writer
that is stopped leaves the table as it was, and one that is started again begins anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.sources import folders

# Versions that are kept for readers that have begun.
KEPT = 2


def numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[1:]) for n in folders.names(spark, path) if n.startswith("v") and n[1:].isdigit())


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of its last version; empty if it has none."""
    found = numbers(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def put(df: DataFrame, path: str) -> int:
    """Write the next version; it may be made from the last one. Versions nobody can have begun to read go."""
    spark = df.sparkSession
    found = numbers(spark, path)
    number = found[-1] + 1 if found else 0
    staged = folders.beside(f"{path}/v{number}")
    df.write.parquet(staged)
    folders.move(spark, staged, f"{path}/v{number}")
    for old in found[:-(KEPT - 1)]:
        folders.drop(spark, f"{path}/v{old}")
    return number


def append(df: DataFrame, path: str) -> None:
    """Add rows to the last version, as files of their own."""
    found = numbers(df.sparkSession, path)
    if found:
        df.write.mode("append").parquet(f"{path}/v{found[-1]}")
    else:
        put(df, path)
