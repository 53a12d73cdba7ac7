"""Content-addressed storage of snapshots (D1-D4 with S9).

The data files of a snapshot move into a store that holds every content once, under its
checksum; the snapshot keeps a ``files`` manifest that names the blob of each file. Reading goes
by the manifest. What no manifest names is swept.

A snapshot is taken in by steps that can be repeated: its files are listed with their checksums
and the list is written; then blobs are put in their places; then what is left of the data folder
goes. The list is there before any file moves, so whoever finds it can finish the rest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keepsake.functions import scalars as s
from keepsake.operators import dedup
from keepsake.session import settle
from keepsake.sources import folders, snapshots, taskfiles

FILES_SCHEMA = "table_path string, path string, checksum string, size bigint"


INDEXED = "files/_SUCCESS"


def is_indexed(spark: SparkSession, snapshot: str) -> bool:
    return folders.exists(spark, f"{snapshot}/{INDEXED}")


def indexed(found: DataFrame) -> DataFrame:
    """(path) of the snapshots of a listing that have a manifest, each once."""
    return taskfiles.holding(found, INDEXED)


def is_complete(spark: SparkSession, snapshot: str) -> bool:
    """Whether all files of a snapshot that was taken in are in the store."""
    return is_indexed(spark, snapshot) and not folders.exists(spark, f"{snapshot}/data")


def blobs(spark: SparkSession, store: str) -> DataFrame:
    """(checksum, size, path) of what the store holds, by listing it."""
    if not folders.exists(spark, store):
        return spark.createDataFrame([], "checksum string, size bigint, path string")
    return taskfiles.listing(spark, store, "[0-9a-f]*").select(F.regexp_extract("path", "([0-9a-f]{32})$", 1).alias("checksum"), "size", "path")


def index(spark: SparkSession, snapshot: str) -> None:
    """Write the manifest of a snapshot's data files."""
    found = taskfiles.checksums(taskfiles.listing(spark, f"{snapshot}/data", "*.parquet"))
    table = F.regexp_extract("path", r"/(data/[^/]+/[^/]+)/[^/]+$", 1)
    found.select(table.alias("table_path"), "path", "checksum", "size").write.mode("overwrite").parquet(f"{snapshot}/files")


def files(spark: SparkSession, snapshot: str) -> DataFrame:
    return spark.read.schema(FILES_SCHEMA).parquet(f"{snapshot}/files")


def numbered(found: DataFrame) -> DataFrame:
    """Files in the form of the deduplication: the order of their paths decides which one is stored."""
    return found.withColumn("file_id", F.col("path"))


def take_in(spark: SparkSession, snapshot: str, store: str) -> None:
    """Move a snapshot's files into the store, or finish doing so; nothing happens to one that is complete."""
    if is_complete(spark, snapshot):
        return
    if not is_indexed(spark, snapshot):
        index(spark, snapshot)
    root = store.rstrip("/")
    named = settle(numbered(files(spark, snapshot)), "dump-files")
    fresh = dedup.new_blobs(named, blobs(spark, store)).select("checksum", F.col("first_id").alias("path"))
    moves = settle(fresh.select("path", F.concat(F.lit(root + "/"), s.blob_path("checksum")).alias("blob")), "moves")
    taskfiles.each(moves, lambda row: taskfiles.move(row["path"], row["blob"]) if taskfiles.exists(row["path"]) else None)
    missing = named.select("checksum").distinct().join(blobs(spark, store).select("checksum"), "checksum", "left_anti")
    if missing.limit(1).count():
        raise FileNotFoundError(f"contents of {snapshot} are neither in its folder nor in the store")
    folders.drop(spark, f"{snapshot}/data")


def read_table(spark: SparkSession, snapshot: str, store: str, entry) -> DataFrame:
    """A table of a snapshot, from the store if its files are there."""
    if entry["path"] is None or not is_complete(spark, snapshot):
        return snapshots.read_table(spark, snapshot, entry)
    schema = T.StructType.fromJson(json.loads(entry["schema_json"]))
    named = files(spark, snapshot).filter(F.col("table_path") == entry["path"])
    # names of one table's files: what a reader of a folder lists on the driver too
    paths = [f"{store.rstrip('/')}/{r['blob']}" for r in named.select(s.blob_path("checksum").alias("blob")).toLocalIterator()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def links(spark: SparkSession, found: list[str]) -> DataFrame:
    """(snapshot, checksum, links) of all files that manifests name."""
    rows = [f"{p}/files" for p in found if is_indexed(spark, p)]
    if not rows:
        return spark.createDataFrame([], "snapshot string, checksum string, links bigint")
    named = spark.read.schema(FILES_SCHEMA).parquet(*rows)
    origin = F.regexp_extract("_metadata.file_path", "^(.*)/files/[^/]+$", 1)
    return named.select(origin.alias("snapshot"), "checksum").groupBy("snapshot", "checksum").agg(F.count(F.lit(1)).alias("links"))


def sweep(spark: SparkSession, store: str, found: list[str]) -> int:
    """Delete what no manifest of the snapshots names; how many blobs went.

    If no blob at all is named, nothing goes: somebody lost the manifests.
    """
    held = settle(blobs(spark, store), "blobs")
    named = links(spark, found).withColumn("size", F.lit(0))
    orphans = settle(dedup.orphan_blobs(named, held).join(held.select(F.col("checksum").alias("c"), "path"), F.col("c") == F.col("checksum")).select("path"), "orphans")
    taskfiles.each(orphans, lambda row: taskfiles.delete(row["path"]))
    return orphans.count()
