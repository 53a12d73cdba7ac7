"""How many files of snapshots link each blob, kept up by what is added and removed.

Every snapshot that is taken in adds one small table of its contents and their counts, every
snapshot that is removed one with the counts negated; the links of a blob are the sum. The tables
are named after the snapshot, so doing it twice is doing it once, and they may come in any order. A snapshot's
name is never used for another.
They are foldered by the first two characters of the checksum: what a question about some
contents reads is the folders of these contents. ``fold`` merges them when they have become many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from keepsake.session import settle
from keepsake.sources import folders

SCHEMA = "checksum string, n bigint"


def _last(spark: SparkSession, path: str) -> tuple[list[str], str | None, set[str]]:
    """Finished tables, the last merged one of them, and the names of all that were ever merged."""
    found = [n for n in folders.names(spark, path) if folders.exists(spark, f"{path}/{n}/_SUCCESS")]
    bases = sorted((n for n in found if n.startswith("base-")), key=lambda n: int(n.split("-")[1]))
    if not bases:
        return found, None, set()
    merged = spark.read.schema("name string").parquet(f"{path}/merged-{bases[-1]}")
    return found, bases[-1], {r["name"] for r in merged.toLocalIterator()}


def _names(spark: SparkSession, path: str) -> list[str]:
    """Tables that count: the last merged one, and those that are not in it."""
    found, base, merged = _last(spark, path)
    return ([base] if base else []) + [n for n in found if n[:4] in ("add-", "sub-") and n not in merged]


def _note(counts: DataFrame, path: str, name: str) -> None:
    """Write a snapshot's table, unless it was merged already."""
    if name not in _last(counts.sparkSession, path)[2]:
        _write(counts, path, name)


def _write(counts: DataFrame, path: str, name: str) -> None:
    rows = counts.withColumn("p", F.substring("checksum", 1, 2))
    rows.hint("rebalance", "p").sortWithinPartitions("p", "checksum").write.mode("overwrite").partitionBy("p").parquet(f"{path}/{name}")


def add(files: DataFrame, path: str, snapshot: str) -> None:
    """Count the ``files(checksum)`` of a snapshot in."""
    _note(files.groupBy("checksum").agg(F.count(F.lit(1)).alias("n")), path, f"add-{snapshot}")


def remove(files: DataFrame, path: str, snapshot: str) -> None:
    """Count them out."""
    _note(files.groupBy("checksum").agg((-F.count(F.lit(1))).alias("n")), path, f"sub-{snapshot}")


def _rows(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    names = _names(spark, path)
    if not names:
        return spark.createDataFrame([], SCHEMA)
    rows = None
    for n in names:
        part = spark.read.schema(f"{SCHEMA}, p string").parquet(f"{path}/{n}")
        rows = part if rows is None else rows.unionByName(part)
    if prefixes is not None:
        rows = rows.filter(F.col("p").isin(prefixes))
    return rows.select("checksum", "n")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(checksum, links) of all contents that are linked."""
    return _rows(spark, path).groupBy("checksum").agg(F.sum("n").alias("links")).filter("links <> 0")


def links_of(contents: DataFrame, path: str) -> DataFrame:
    """(checksum, links) of some contents; 0 for those that nothing links. Only their folders are read."""
    spark = contents.sparkSession
    asked = settle(contents.select("checksum").distinct(), "asked")
    # at most 256 of two hex digits
    prefixes = [r["p"] for r in asked.select(F.substring("checksum", 1, 2).alias("p")).distinct().collect()]
    held = _rows(spark, path, prefixes).join(asked, "checksum", "left_semi").groupBy("checksum").agg(F.sum("n").alias("links"))
    return asked.join(held, "checksum", "left").select("checksum", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def fold(spark: SparkSession, path: str) -> None:
    """Merge all tables into one. The merged table counts from the moment its list of names is there."""
    names = _names(spark, path)
    if len(names) < 2:
        return
    _, base, merged = _last(spark, path)
    number = int(base.split("-")[1]) + 1 if base else 1
    name = f"base-{number}-{uuid.uuid4().hex}"
    done = [n for n in names if n != base]
    # names of all snapshots so far, one short row each
    listed = spark.createDataFrame([(n,) for n in sorted(merged | set(done))], "name string")
    # the list first: a list without its table is not looked at
    listed.coalesce(1).write.parquet(f"{path}/merged-{name}")
    _write(counts(spark, path).withColumnRenamed("links", "n"), path, name)
    for n in done + ([base, f"merged-{base}"] if base else []):
        folders.drop(spark, f"{path}/{n}")
