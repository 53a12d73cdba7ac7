"""Retention against a plain Python model, and its properties."""

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import retention as r
from keepsake.plans.clean import plan_clean
from keepsake.sources.schemas import conform, schema_of


def month_back(d, months):
    y, m = divmod(d.year * 12 + d.month - 1 - months, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def model_slices(now, policy):
    end = now.date() + dt.timedelta(days=1)
    out = []
    for kind, n in zip("DWMY", policy):
        for _ in range(n):
            start = {"D": lambda: end - dt.timedelta(days=1), "W": lambda: end - dt.timedelta(days=7),
                     "M": lambda: month_back(end, 1), "Y": lambda: month_back(end, 12)}[kind]()
            out.append((kind, len(out) + 1, start, end))
            end = start
    return out


def model_keep(rows, policies, now):
    keep = set()
    for job, policy in policies.items():
        for kind, _, start, end in model_slices(now, policy):
            hit = [x for x in rows if x["job"] == job and x["status"] == "SUCCESS" and x["keep"] == "AUTO" and start <= x["start"].date() < end]
            if hit:
                best = max if kind == "D" else min
                t = best(x["start"] for x in hit)
                keep.add(min(x["id"] for x in hit if x["start"] == t))
    return keep


def catalog_of(spark, rows):
    data = [(x["id"], x["job"], x["start"], x["status"], x["keep"], "/data/snapshots/a", f"d{x['id']}") for x in rows]
    df = spark.createDataFrame(data, "id int, dumpjob_id int, starttime timestamp_ntz, status string, keep string, bu_location string, bu_name string")
    return conform(df, "catalog")


def random_rows(seed, now, n=600, hot=True):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        days = g.choice([g.uniform(0, 12), g.uniform(0, 60), g.uniform(0, 900), -g.uniform(0, 3)])
        start = (now - dt.timedelta(days=days)).replace(microsecond=0)
        if g.random() < 0.2:
            start = start.replace(hour=12, minute=0, second=0)
        rows.append({"id": i, "job": 1 if hot and g.random() < 0.4 else g.choice([1, 2, 3, 4, None]), "start": start,
                     "status": g.choice(["SUCCESS"] * 6 + ["FAILED", "REMOVING"]), "keep": g.choice(["AUTO"] * 8 + ["YES", "NO"])})
    return rows


POLICIES = {1: (14, 2, 5, 2), 2: (0, 4, 0, 1), 3: (3, 0, 7, 0)}


def dumpjobs(spark):
    rows = [(k, *v) for k, v in POLICIES.items()]
    return conform(spark.createDataFrame(rows, "id int, keep_daily int, keep_weekly int, keep_monthly int, keep_yearly int"), "dumpjob")


def restorejobs(spark, ids):
    return conform(spark.createDataFrame([(i, c) for i, c in enumerate(ids)] or [(0, None)], "id int, catalog_id int"), "restorejob")


@pytest.mark.parametrize("now", [dt.datetime(2001, 3, 30, 12), dt.datetime(2000, 2, 28, 23, 59, 59), dt.datetime(2001, 7, 31), dt.datetime(2004, 2, 29, 1)])
def test_slices_and_keep_match_the_model(spark, now):
    rows = random_rows(now.day, now)
    catalog, jobs = catalog_of(spark, rows), dumpjobs(spark)
    policies = {**POLICIES, 4: r.DELETED_JOB_POLICY}
    slices = r.retention_slices(r.job_retention_info(catalog, jobs), now).collect()
    assert {(x[0], *x[1:]) for x in slices} == {(j, *s) for j, p in policies.items() for s in model_slices(now, p)}
    picked = r.retention_keep(catalog, jobs, now).collect()
    assert {x["id"] for x in picked} == model_keep(rows, policies, now)
    assert len({(x["dumpjob_id"], x["slice_no"]) for x in picked}) == len(picked)


def test_clamped_day_stays_clamped(spark):
    now = dt.datetime(2001, 3, 30)
    got = [x[2:] for x in model_slices(now, (0, 0, 3, 0))]
    assert got == [(dt.date(2001, 2, 28), dt.date(2001, 3, 31)), (dt.date(2001, 1, 28), dt.date(2001, 2, 28)), (dt.date(2000, 12, 28), dt.date(2001, 1, 28))]
    info = spark.createDataFrame([(1, 0, 0, 3, 0)], "dumpjob_id int, keep_daily int, keep_weekly int, keep_monthly int, keep_yearly int")
    rows = r.retention_slices(info, now).orderBy("slice_no").collect()
    assert [(x["slice_start"], x["slice_end"]) for x in rows] == got


def test_remove_properties(spark):
    now = dt.datetime(2001, 3, 30, 12)
    rows = random_rows(5, now)
    catalog, jobs, restores = catalog_of(spark, rows), dumpjobs(spark), restorejobs(spark, [3, 5, None, 10_000])
    keep = {x[0] for x in r.keep_set(catalog, jobs, restores, now).collect()}
    gone = {x["id"] for x in r.retention_remove(catalog, jobs, restores, now).collect()}
    with_job = {x["id"] for x in rows if x["job"] is not None}
    assert keep & gone == set() and (keep | gone) >= with_job and gone <= with_job
    assert {x["id"] for x in rows if x["keep"] == "YES"} | {3, 5} <= keep
    assert {x["id"] for x in rows if x["job"] is not None and x["status"] == "FAILED" and x["keep"] != "YES"} - {3, 5} <= gone
    left = catalog_of(spark, [x for x in rows if x["id"] not in gone])
    again = {x["id"] for x in r.retention_remove(left, jobs, restores, now).collect()}
    assert again == set()


def test_policy_for_deleted_jobs_from_settings(spark):
    empty = spark.createDataFrame([], schema_of("setting"))
    assert r.deleted_job_policy(empty) == (7, 1, 0, 0)
    assert r.deleted_job_policy(spark.createDataFrame([(1, "retention_on_delete", "3|2|1|0")], schema_of("setting"))) == (3, 2, 1, 0)


def test_unsafe_reasons(spark):
    paths = [("/a", "path too short"), ("/data/../x/y", "path contains /../"), ("/tmp/abcdef", "path outside snapshot root"), ("/data/snapshots/x", None), (None, "no path")]
    df = spark.createDataFrame([(p,) for p, _ in paths], "p string").select("p", r.unsafe_reason("p", "/data/snapshots").alias("why"))
    assert {(x[0], x[1]) for x in df.collect()} == set(paths)


def test_clean_plan(spark):
    now = dt.datetime(2001, 3, 30, 12)
    rows = [
        {"id": 1, "job": 1, "start": dt.datetime(2001, 3, 30, 1), "status": "SUCCESS", "keep": "AUTO"},
        {"id": 2, "job": 1, "start": dt.datetime(2001, 3, 30, 0), "status": "SUCCESS", "keep": "AUTO"},
        {"id": 3, "job": 1, "start": dt.datetime(2001, 3, 29, 0), "status": "FAILED", "keep": "AUTO"},
        {"id": 4, "job": None, "start": dt.datetime(2001, 3, 29, 0), "status": "FAILED", "keep": "AUTO"},
    ]
    catalog = catalog_of(spark, rows)
    log = conform(spark.createDataFrame([(1, "RUNNING", "/data/snapshots/a/d3"), (2, "RUNNING", "/x"), (3, "RUNNING", None)], "id int, status string, bu_path string"), "restorelog")
    files = spark.createDataFrame([(1, 1, "a", "k1", 5), (2, 2, "b", "k1", 5), (3, 2, "c", "k2", 7)], "file_id int, dump_id int, path string, checksum string, size bigint")
    store = files.select("checksum", "size").distinct()
    plan = plan_clean(catalog, dumpjobs(spark), restorejobs(spark, []), log, files, store, now, "/data/snapshots")
    assert [x["id"] for x in plan.removable.collect()] == [2]  # 3 is being restored
    assert [x["checksum"] for x in plan.blobs.collect()] == ["k2"]
    assert {x["id"] for x in plan.catalog.collect()} == {1, 3, 4}
    assert {x["checksum"] for x in plan.store.collect()} == {"k1"}
    assert plan.files.count() == 1
    assert plan.summary(3).first()["message"] == "removed 1 dumps and 1 files from dedup store"


def test_set_column_last_change_wins(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, status string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, " ", 1)], "id int, value string, at int")
    assert sorted((x[0], x[1]) for x in r.set_column(table, changes, "status").collect() if x[1]) == [(1, "y"), (3, "c")]
    assert r.set_column(table, changes, "status").filter(F.col("status").isNull()).first()["id"] == 2
