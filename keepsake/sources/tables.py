"""Typed parquet scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from keepsake.sources.schemas import schema_of


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Catalog table ``name`` from ``folder``, with its declared types."""
    return spark.read.schema(schema_of(name)).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scan_report(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and key range of each table; only the key column is read."""
    parts = [
        df.select(F.col(key).cast("bigint").alias("k")).agg(
            F.count(F.lit(1)).alias("row_count"), F.min("k").alias("min_id"), F.max("k").alias("max_id")
        ).select(F.lit(name).alias("table_name"), "row_count", "min_id", "max_id")
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
