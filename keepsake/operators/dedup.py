"""Content deduplication.

Files carry ``file_id, dump_id, path, checksum, size``; the store ``checksum, size``.
Work that depends on the checksum is done on one pre-aggregated row per checksum and
goes back to the files by their unique id, so many copies of one file never meet in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepsake.functions import scalars as s
from keepsake.session import settle


def first_files(files: DataFrame) -> DataFrame:
    """(checksum, first_id, first_size): the first file that carries each checksum."""
    return files.groupBy("checksum").agg(
        F.min("file_id").alias("first_id"), F.min_by("size", "file_id").alias("first_size")
    )


def first_occurrence(files: DataFrame) -> DataFrame:
    """Each file with ``is_first``."""
    firsts = first_files(files).select("first_id")
    return files.join(firsts, F.col("file_id") == F.col("first_id"), "left").withColumn(
        "is_first", F.col("first_id").isNotNull()
    ).drop("first_id")


def new_blobs(files: DataFrame, store: DataFrame) -> DataFrame:
    """First files of checksums that the store does not hold yet."""
    known = store.select(F.col("checksum").alias("known"))
    return first_files(files).join(known, F.col("checksum") == F.col("known"), "left_anti")


def dedup_classify(files: DataFrame, store: DataFrame) -> DataFrame:
    """Each file with ``action`` STORE (moves into the store) or LINK, and its blob path."""
    fresh = new_blobs(files, store).select("first_id")
    return files.join(fresh, F.col("file_id") == F.col("first_id"), "left").select(
        *files.columns,
        F.when(F.col("first_id").isNotNull(), F.lit("STORE")).otherwise(F.lit("LINK")).alias("action"),
        s.blob_path("checksum").alias("blob"),
    )


def store_update(files: DataFrame, store: DataFrame) -> DataFrame:
    fresh = new_blobs(files, store).select("checksum", F.col("first_size").alias("size"))
    return store.select("checksum", "size").unionByName(fresh)


def write_store(store: DataFrame, path: str) -> None:
    """Store table foldered by the first two checksum characters."""
    (
        store.withColumn("p1", F.substring("checksum", 1, 1)).withColumn("p2", F.substring("checksum", 2, 1))
        .hint("rebalance", "p1", "p2")
        .write.partitionBy("p1", "p2").parquet(path)
    )


def dedup_once(files: DataFrame, catalog: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files of FULL dumps that are not indexed yet (``indexed(dump_id)``)."""
    full = catalog.filter(F.col("dumptype") == "FULL").select(F.col("id").alias("full_id"))
    todo = full.join(indexed.select(F.col("dump_id").alias("done_id")), F.col("full_id") == F.col("done_id"), "left_anti")
    return files.join(todo, F.col("dump_id") == F.col("full_id"), "left_semi")


def dedup_read(files: DataFrame, store: DataFrame) -> DataFrame:
    """Links resolved: each file with what the store holds under its checksum."""
    blobs = store.select(F.col("checksum").alias("b_checksum"), *[F.col(c).alias("blob_" + c) for c in store.columns if c != "checksum"])
    return files.join(blobs, F.col("checksum") == F.col("b_checksum")).drop("b_checksum")


def dedup_summary(classified: DataFrame, base_size=0) -> DataFrame:
    """Per dump: bytes, bytes newly stored, files that existed already, remaining percent.

    ``base_size`` counts into both sums (the table of contents of a dump).
    """
    base = F.lit(base_size).cast("bigint")
    sums = classified.groupBy("dump_id").agg(
        F.sum("size").alias("all_bytes"),
        F.sum(F.when(F.col("action") == "STORE", F.col("size")).otherwise(F.lit(0))).alias("new_bytes"),
        F.count_if(F.col("action") == "LINK").alias("existing_files"),
    )
    total, stored = base + F.col("all_bytes"), base + F.col("new_bytes")
    return sums.select(
        "dump_id", total.alias("total_bytes"), stored.alias("stored_bytes"), "existing_files",
        s.percent_text(stored, total).alias("remaining_percent"),
    )


def link_counts(files: DataFrame, store: DataFrame) -> DataFrame:
    """(checksum, size, links) of every blob in the store."""
    counts = files.groupBy(F.col("checksum").alias("l_checksum")).agg(F.count(F.lit(1)).alias("n"))
    return store.join(counts, F.col("checksum") == F.col("l_checksum"), "left").select(
        "checksum", "size", s.null_default("n", F.lit(0).cast("bigint")).alias("links")
    )


def orphan_blobs(files: DataFrame, store: DataFrame) -> DataFrame:
    """Blobs without a link. If no blob at all has one, nothing: somebody lost the links.

    The counts serve the answer and the safety check, so they are written down once.
    """
    counted = settle(link_counts(files, store), "link-counts")
    any_link = counted.filter(F.col("links") > 0).select("checksum").limit(1)
    return counted.filter(F.col("links") == 0).select("checksum", "size").where(any_link.exists())


def orphan_after_remove(files: DataFrame, removed: DataFrame) -> DataFrame:
    """Checksums that only the removed dumps (``removed(dump_id)``) link."""
    gone = removed.select(F.col("dump_id").alias("gone_id")).distinct()
    marked = files.select("checksum", "dump_id").join(gone, F.col("dump_id") == F.col("gone_id"), "left")
    return (
        marked.groupBy("checksum")
        .agg(F.count("gone_id").alias("gone_links"), F.count(F.lit(1)).alias("links"))
        .filter(F.col("gone_links") == F.col("links"))
        .select("checksum", F.col("gone_links").alias("removed_links"))
    )
