"""The retention clean as one plan over all jobs: what goes, which blobs go with it, what is left."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keepsake.functions import scalars as s
from keepsake.operators import dedup, retention
from keepsake.plans.home import Home
from keepsake.session import settle
from keepsake.sources import linkcounts, taskfiles, vault


@dataclass
class CleanPlan:
    """What a clean would do; nothing has been removed yet."""

    removable: DataFrame
    held_back: DataFrame
    blobs: DataFrame
    catalog: DataFrame
    files: DataFrame
    store: DataFrame
    now: object

    def summary(self, worker) -> DataFrame:
        """The message row of the run: how many dumps and blobs went."""
        dumps = self.removable.select(F.lit(1).alias("d"), F.lit(0).alias("b"))
        blobs = self.blobs.select(F.lit(0).alias("d"), F.lit(1).alias("b"))
        counts = dumps.unionByName(blobs).agg(
            F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")
        )
        text = s.concat_null(F.lit("removed "), "d", F.lit(" dumps and "), "b", F.lit(" files from dedup store"))
        return counts.select(
            F.lit("INFO").alias("level"), F.lit("clean").alias("tool"), s.moment(self.now).alias("logtime"),
            text.alias("message"), F.lit("CLEAN").alias("jobclass"), F.lit(-1).alias("jobid"),
            F.lit(str(worker)).alias("bu_worker_id"),
        )


def plan_clean(
    catalog: DataFrame, dumpjob: DataFrame, restorejob: DataFrame, restorelog: DataFrame, files: DataFrame,
    store: DataFrame, now, root: str, deleted=retention.DELETED_JOB_POLICY,
) -> CleanPlan:
    checked = retention.remove_safe(retention.retention_remove(catalog, dumpjob, restorejob, now, deleted), root)
    # Both lists serve several results below.
    removable = settle(retention.remove_not_restoring(checked, restorelog), "removable")
    gone = removable.select(F.col("id").alias("dump_id"))
    lost = settle(dedup.orphan_after_remove(files, gone).select(F.col("checksum").alias("lost")), "lost-blobs")
    blobs = store.join(lost, F.col("checksum") == F.col("lost"), "left_semi")
    return CleanPlan(
        removable=removable,
        held_back=checked.filter(F.col("reason").isNotNull()),
        blobs=blobs,
        catalog=retention.delete_ids(catalog, removable),
        files=files.join(gone.withColumnRenamed("dump_id", "gone"), F.col("dump_id") == F.col("gone"), "left_anti"),
        store=store.join(lost, F.col("checksum") == F.col("lost"), "left_anti"),
        now=now,
    )


# Steps of a clean, in order. Each can be repeated, and a clean that was stopped starts again at the first.
STEPS = ("mark", "unlink", "blobs", "folders", "rows", "message")


def apply_clean(home: Home, now, worker: int = 0, deleted=retention.DELETED_JOB_POLICY, stop_after: str | None = None) -> DataFrame:
    """Remove what the retention policies of all jobs let go, and return the removed catalog rows.

    What goes is marked REMOVING first; marked rows are let go by every later clean, so a clean
    that stops anywhere is ended by the next one. Then links are counted out, contents that have
    none left are deleted, then folders, and the catalog rows last. One clean or dump at a time.
    """
    spark = home.spark
    catalog = home.table("catalog")
    checked = retention.remove_safe(retention.retention_remove(catalog, home.table("dumpjob"), home.table("restorejob"), now, deleted), home.root)
    removable = settle(retention.remove_not_restoring(checked, home.table("restorelog")), "removable")
    gone = removable.select("id", "path")

    def mark() -> None:
        change = gone.select("id", F.lit("REMOVING").alias("value"), F.lit(None).cast("timestamp_ntz").alias("at"))
        home.put("catalog", retention.set_column(catalog, change, "status"))

    def unlink() -> None:
        # snapshots that were taken in have a manifest of files; these are named by path, one by one, not read here
        for path in indexed:
            linkcounts.remove(vault.files(spark, path), home.links, path.rsplit("/", 1)[1])

    def blobs() -> None:
        if not indexed:
            return
        contents = reduce(DataFrame.unionByName, [vault.files(spark, p).select("checksum") for p in indexed])
        free = linkcounts.links_of(contents, home.links).filter("links = 0")
        lost = settle(free.select(F.concat(F.lit(home.store + "/"), s.blob_path("checksum")).alias("path")), "lost-blobs")
        taskfiles.each(lost, lambda row: taskfiles.delete(row["path"]))

    def drop_folders() -> None:
        taskfiles.each(removable.select("path"), lambda row: taskfiles.delete(row["path"]))

    def rows() -> None:
        home.put("catalog", retention.delete_ids(home.table("catalog"), removable))

    def message() -> None:
        if removable.limit(1).count():
            home.say("INFO", "clean", now, f"removed {removable.count()} dumps", "CLEAN", -1, worker)

    # most dumps of a catalog may have no manifest here: they are looked up by tasks, and only those that have one are named
    indexed = [r["path"] for r in settle(vault.indexed(gone), "indexed").toLocalIterator()]
    for name, step in zip(STEPS, (mark, unlink, blobs, drop_folders, rows, message)):
        step()
        if name == stop_after:
            break
    return removable
