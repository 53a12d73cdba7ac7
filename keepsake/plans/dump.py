"""The dump path from the gate to the triggered restores, over the tables of a home.

Gate → job state → snapshot → catalog row → on-demand flag → deduplication and link counts →
restores of the job's list, each with its log row and job state. The catalog row's id is given,
and a dump whose row is there is not taken again: a run that was stopped goes on behind it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from keepsake.operators import jobs
from keepsake.plans.home import Home
from keepsake.sources import folders, snapshots as sn, vault
from keepsake.sources.schemas import conform

# Key of the on-demand flag, and what it may say.
FLAG = "TAKE_BACKUP"
FIRST_USE, WANTED, DONE = "SCHEDULE", "YES", "NO"


@dataclass
class Outcome:
    decision: str
    snapshot: str | None = None
    status: str | None = None
    restored: list[sn.Restored] = field(default_factory=list)


def flags(home: Home) -> DataFrame:
    """(dbname, val): the on-demand flag of every database."""
    parts = F.split("key", "/", 2)
    return home.table("metainfo").filter(F.get(parts, 0) == FLAG).select(F.get(parts, 1).alias("dbname"), "val")


def flag_of(home: Home, dbname: str) -> str | None:
    row = flags(home).filter(F.col("dbname") == dbname).select("val").first()
    return row["val"] if row else None


def set_flag(home: Home, dbname: str, value: str) -> None:
    key = f"{FLAG}/{dbname}"
    rest = home.table("metainfo").filter(F.col("key") != key)
    home.put("metainfo", rest.unionByName(home.spark.createDataFrame([(key, value)], "key string, val string")))


def read_from(home: Home):
    return lambda spark, snapshot, entry: vault.read_table(spark, snapshot, home.store, entry)


def run_dump(
    home: Home, databases: dict[str, sn.Tables], job_id: int, catalog_id: int, now: dt.datetime,
    start_type: str = "CRON", on_demand: bool = False, restore_root: str | None = None,
) -> Outcome:
    """Run one dump job at ``now``; its restores go below ``restore_root``, one folder per instance."""
    spark = home.spark
    job = home.table("dumpjob").filter(F.col("id") == job_id)
    row = job.first()
    if row is None:
        raise LookupError(f"no dump job {job_id}")
    asked = on_demand and start_type != "SINGLE"
    if asked and flag_of(home, row["dbname"]) is None:
        set_flag(home, row["dbname"], FIRST_USE)
    done = home.table("catalog").filter(F.col("id") == catalog_id).first()
    if done is None:
        gate = jobs.dump_eligibility(job, home.table("worker"), home.table("instance"), flags(home), start_type, on_demand).first()
        decision = gate["decision"] if gate else "QUIT"
        # a job that runs once is halted before it runs, so that it can't start over and over
        if decision in ("RUN", "ON_DEMAND_SKIP") and row["jobtype"] == "SINGLE":
            home.set_value("dumpjob", job_id, "status", "HALTED")
        if decision == "ON_DEMAND_SKIP":
            home.say("INFO", "dump", now, f"dump job id {job_id} aborted by on demand status of the database ({FLAG}={DONE})", "DUMP", job_id, row["worker_id"])
        if decision != "RUN":
            return Outcome(decision)
        instance = home.table("instance").filter(F.col("id") == row["pgsql_instance_id"]).first()
        spec = sn.DumpJob(
            job_id, row["dbname"], row["dumptype"], row["dumpschema"], row["dumpoptions"] or "", row["comment"], row["worker_id"],
            instance["dns_name"], instance["pgport"])
        path = f"{sn.job_folder(home.root, spec)}/{sn.snapshot_name(spec, now.strftime('%Y%m%dT%H%M%S'))}"
        folders.drop(spark, path)  # of a run that was stopped before its catalog row
        shot = sn.snapshot_write(spark, databases, home.root, spec, now)
        home.append("catalog", conform(shot.catalog_row, "catalog").withColumn("id", F.lit(catalog_id).cast("int")))
        status = shot.status
    else:
        path, status = f"{done['bu_location']}/{done['bu_name']}", done["status"]
    if status != "SUCCESS":
        return Outcome("RUN", path, status)
    if flag_of(home, row["dbname"]) == WANTED:
        set_flag(home, row["dbname"], DONE)
    if row["dumptype"] == "FULL":
        home.take_in(path)
    wanted = [int(i) for i in (row["restorejob_id"] or "").split(",") if i.strip()]
    restored = [run_restore(home, i, path, now, restore_root) for i in wanted] if restore_root else []
    return Outcome("RUN", path, status, [r for r in restored if r])


def run_restore(home: Home, restore_id: int, snapshot: str, now: dt.datetime, restore_root: str, catalog_id: int | None = None) -> sn.Restored | None:
    """Run one restore job from a snapshot, with its log row. A restore that is done for this dump is not done again."""
    found = home.table("restorejob").filter(F.col("id") == restore_id).first()
    if found is None:
        return None
    before = home.table("restorelog").filter((F.col("restorejob_id") == restore_id) & (F.col("bu_path") == snapshot) & (F.col("status") != "ERROR"))
    if before.limit(1).count():
        return None
    spec = sn.RestoreJob(
        restore_id, f"{restore_root}/{found['dest_pgsql_instance_id']}", found["dest_dbname"], found["restoretype"], found["restoreschema"], found["existing_db"])
    result = sn.snapshot_restore(home.spark, snapshot, spec, read_from(home))
    # a destination that is to be left alone stops the job, and a job that runs once has run
    if result.status == "ABORTED" or found["jobtype"] == "SINGLE":
        home.set_value("restorejob", restore_id, "status", "HALTED")
    home.append("restorelog", sn.restore_log(home.spark, [result], snapshot, now, now))
    return result
