"""Retention: which dumps stay and which go.

One plan covers all jobs. Slices depend on the keep values only, and few jobs differ in
them: the slices of each policy are laid out as a calendar of days, and a dump finds its
slice by its day with plain equality. The dumps are neither multiplied nor compared
with ranges, and they are combined to one candidate per (job, slice) before any shuffle.
Job policies and calendar are written down first, so their size is known when the join
is planned: where it allows a broadcast the catalog is not shuffled at all, and beyond
that the skewed side of the join by job is split at run time, while the join by day
spreads over the days. A job that holds a third of the catalog is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keepsake.functions import scalars as s
from keepsake.session import settle

# Fixed value: (daily, weekly, monthly, yearly) for jobs that no longer exist.
DELETED_JOB_POLICY = (7, 1, 0, 0)
# Fixed value: name of the setting that replaces it, as ``d|w|m|y``.
DELETED_JOB_SETTING = "retention_on_delete"
# Fixed value: shortest path that may be removed.
MIN_PATH_LENGTH = 6

KEEP_COLUMNS = ("keep_daily", "keep_weekly", "keep_monthly", "keep_yearly")
_SLICE = "array<struct<kind:string,slice_no:int,slice_start:date,slice_end:date>>"


def deleted_job_policy(setting: DataFrame) -> tuple[int, int, int, int]:
    """The policy for deleted jobs from the settings table (one looked-up value)."""
    row = setting.filter(F.col("key") == DELETED_JOB_SETTING).select("value").first()
    if row is None or not row[0]:
        return DELETED_JOB_POLICY
    d, w, m, y = (int(x) for x in row[0].split("|"))
    return d, w, m, y


def job_retention_info(
    catalog: DataFrame, dumpjob: DataFrame, deleted: tuple[int, int, int, int] = DELETED_JOB_POLICY
) -> DataFrame:
    """Every job that has dumps, with its keep values; dumps without a job belong to none."""
    jobs = catalog.select("dumpjob_id").filter(F.col("dumpjob_id").isNotNull()).distinct()
    kept = dumpjob.select(F.col("id").alias("j_id"), *KEEP_COLUMNS)
    return jobs.join(kept, F.col("j_id") == F.col("dumpjob_id"), "left").select(
        "dumpjob_id", *[s.null_default(c, v).alias(c) for c, v in zip(KEEP_COLUMNS, deleted)]
    )


def slice_array(now) -> Column:
    """Slices of one policy row, youngest first, contiguous backwards from the end of today.

    Steps are folded one after the other, so a day of month that was clamped
    (31 March, 28 February) stays clamped (28 January).
    """
    end0 = F.date_add(s.moment(now).cast("date"), 1)
    kinds = F.concat(
        *[F.array_repeat(F.lit(k), F.greatest(F.col(c), F.lit(0))) for k, c in zip("DWMY", KEEP_COLUMNS)]
    )

    def step(acc: Column, kind: Column) -> Column:
        end = acc["e"]
        start = (
            F.when(kind == "D", F.date_sub(end, 1))
            .when(kind == "W", F.date_sub(end, 7))
            .when(kind == "M", F.add_months(end, -1))
            .otherwise(F.add_months(end, -12))
        )
        done = F.struct(
            kind.alias("kind"), (F.size(acc["out"]) + 1).alias("slice_no"),
            start.alias("slice_start"), end.alias("slice_end"),
        )
        return F.struct(start.alias("e"), F.array_append(acc["out"], done).alias("out"))

    zero = F.struct(end0.alias("e"), F.array().cast(_SLICE).alias("out"))
    return F.aggregate(kinds, zero, step, lambda acc: acc["out"])


def retention_slices(policies: DataFrame, now) -> DataFrame:
    """(dumpjob_id, kind, slice_no, slice_start, slice_end); slice_no counts from the youngest."""
    return policies.select("dumpjob_id", F.inline(slice_array(now)))


def eligible(catalog: DataFrame) -> DataFrame:
    return catalog.filter((F.col("status") == "SUCCESS") & (F.col("keep") == "AUTO"))


def policy_calendar(policies: DataFrame, now) -> DataFrame:
    """One row per day of every distinct policy with the slice the day belongs to."""
    slices = policies.select(*KEEP_COLUMNS).distinct().select(*KEEP_COLUMNS, F.inline(slice_array(now)))
    days = F.sequence("slice_start", F.date_sub("slice_end", 1))
    return slices.select("*", F.explode(days).alias("day"))


def slice_pick(catalog: DataFrame, policies: DataFrame, now) -> DataFrame:
    """The dump each slice keeps: the newest of a day slice, the oldest of a longer slice.

    On equal times it is the lower id.
    """
    end0 = F.date_add(s.moment(now).cast("date"), 1).cast("timestamp_ntz")
    dumps = eligible(catalog).filter(F.col("dumpjob_id").isNotNull() & (F.col("starttime") < end0)).select(
        "dumpjob_id", "starttime", "id", F.col("starttime").cast("date").alias("day")
    )
    micros = F.unix_micros(F.col("starttime").cast("timestamp_ltz"))
    rank = F.when(F.col("kind") == "D", -micros).otherwise(micros)
    return (
        dumps.join(policies, "dumpjob_id")
        .join(settle(policy_calendar(policies, now), "calendar"), [*KEEP_COLUMNS, "day"])
        .groupBy("dumpjob_id", "slice_no", "kind", "slice_start", "slice_end")
        .agg(F.min(F.struct(rank.alias("rank"), "id")).alias("best"))
        .select("dumpjob_id", "kind", "slice_no", "slice_start", "slice_end", F.col("best.id").alias("id"))
    )


def retention_keep(catalog: DataFrame, dumpjob: DataFrame, now, deleted=DELETED_JOB_POLICY) -> DataFrame:
    return slice_pick(catalog, settle(job_retention_info(catalog, dumpjob, deleted), "policies"), now)


def named_ids(restorejob: DataFrame) -> DataFrame:
    """(named_id): dumps that restore jobs name."""
    return restorejob.select(F.col("catalog_id").alias("named_id")).filter(F.col("named_id").isNotNull()).distinct()


def retention_pinned(catalog: DataFrame, restorejob: DataFrame) -> DataFrame:
    """Ids that always stay: marked YES or named by a restore job."""
    linked = catalog.select("id", "keep").join(named_ids(restorejob), F.col("id") == F.col("named_id"), "left")
    return linked.filter((F.col("keep") == "YES") | F.col("named_id").isNotNull()).select("id").distinct()


def keep_set(catalog: DataFrame, dumpjob: DataFrame, restorejob: DataFrame, now, deleted=DELETED_JOB_POLICY) -> DataFrame:
    picks = retention_keep(catalog, dumpjob, now, deleted).select("id")
    return picks.union(retention_pinned(catalog, restorejob)).distinct()


def remove_set(catalog: DataFrame, keep: DataFrame) -> DataFrame:
    """Dumps of any job that are not in the keep set. Dumps without a job are left alone."""
    kept = keep.select(F.col("id").alias("kept_id"))
    return catalog.filter(F.col("dumpjob_id").isNotNull()).join(kept, F.col("id") == F.col("kept_id"), "left_anti")


def retention_remove(
    catalog: DataFrame, dumpjob: DataFrame, restorejob: DataFrame, now, deleted=DELETED_JOB_POLICY
) -> DataFrame:
    """All dumps that the next clean removes, with their full path.

    Failed, half-removed and unkept dumps go too, and so do dumps dated after today.
    The ids to keep are written down first (one number per slice and named dump). As
    their size is known then, a small keep set is matched without shuffling the catalog.
    Dumps marked YES are left out on the way, so the catalog is read three times: for its
    jobs, for the slices, and here.
    """
    picks = retention_keep(catalog, dumpjob, now, deleted).select("id")
    keep = settle(picks.union(named_ids(restorejob)).distinct(), "keep-ids")
    gone = remove_set(catalog.filter(F.coalesce(F.col("keep") != "YES", F.lit(True))), keep)
    return gone.select("id", "dumpjob_id", "starttime", "bu_name", s.full_path("bu_location", "bu_name").alias("full_path"))


def remove_path(full_path: Column | str = "full_path") -> Column:
    return s.strip_extension(full_path)


def unsafe_reason(path: Column | str, root: str) -> Column:
    """Why a path must not be removed; null if it may."""
    p = s.col(path)
    return (
        F.when(p.isNull(), F.lit("no path"))
        .when(F.length(p) < MIN_PATH_LENGTH, F.lit("path too short"))
        .when(F.contains(p, F.lit("/../")), F.lit("path contains /../"))
        .when(~F.startswith(p, F.lit(root.rstrip("/") + "/")), F.lit("path outside snapshot root"))
    )


def remove_safe(removable: DataFrame, root: str) -> DataFrame:
    """Adds ``path`` and ``reason``; rows with a reason stay where they are."""
    marked = removable.withColumn("path", remove_path("full_path"))
    return marked.withColumn("reason", unsafe_reason("path", root))


def remove_not_restoring(safe: DataFrame, restorelog: DataFrame) -> DataFrame:
    """Rows without a reason whose dump no running restore reads."""
    running = (
        restorelog.filter((F.col("status") == "RUNNING") & F.col("bu_path").isNotNull())
        .select(s.strip_extension("bu_path").alias("running_path")).distinct()
    )
    return (
        safe.filter(F.col("reason").isNull()).drop("reason")
        .join(running, F.col("path") == F.col("running_path"), "left_anti")
    )


def mark_remove(catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """The catalog with ``keep`` = NO on all dumps of the jobs in ``jobs(dumpjob_id)``."""
    marked = jobs.select(F.col("dumpjob_id").alias("m_job")).distinct()
    joined = catalog.join(marked, F.col("dumpjob_id") == F.col("m_job"), "left")
    return joined.withColumn(
        "keep", F.when(F.col("m_job").isNotNull(), F.lit("NO")).otherwise(F.col("keep"))
    ).drop("m_job")


def set_column(table: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """The table with ``column`` replaced where ``changes(id, value, at)`` says so.

    The last change per id wins; blank text means null.
    """
    last = changes.groupBy(F.col("id").alias("c_id")).agg(F.max(F.struct("at", "value")).alias("c"))
    kind = table.schema[column].dataType
    joined = table.join(last, F.col("id") == F.col("c_id"), "left")
    return joined.withColumn(
        column,
        F.when(F.col("c_id").isNotNull(), s.blank_to_null(F.col("c.value").cast("string")).cast(kind)).otherwise(F.col(column)),
    ).drop("c_id", "c")


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    gone = ids.select(F.col(key).alias("gone_id"))
    return table.join(gone, F.col(key) == F.col("gone_id"), "left_anti")


def dumps_per_job(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("dumpjob_id").agg(F.count(F.lit(1)).alias("dumps"))
