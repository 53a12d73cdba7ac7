"""Filters on lists and the same filters on the tables the lists are made from."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keepsake.operators import filters as f, views as v
from keepsake.sources.schemas import conform

NAMES = ["db1", "db1.x", "db10", "d_1", "dX1", "a/b", "", None, "db%", "Db1"]


@pytest.fixture(scope="module")
def bases(spark, tmp_path_factory):
    rows = [(i, None if i % 11 == 5 else i % 9, NAMES[i % 10], ["*", "s.1", None, "x/y"][i // 10 % 4], i % 3, ["SINGLE", "REPEAT", "TRIGGER", None][i % 4], None if i % 7 == 3 else "1 2 * * *") for i in range(240)]
    df = spark.createDataFrame(rows, "id int, n int, db string, schema string, worker int, kind string, cron string")
    made = {
        "catalog": df.select("id", F.col("n").alias("dumpjob_id"), F.col("db").alias("dbname"), F.col("schema").alias("dumpschema"), F.col("worker").alias("bu_worker_id"),
                             F.lit("p").alias("pgsql_dns_name"), F.lit(1).alias("pgsql_port")),
        "restorelog": df.select("id", F.col("n").alias("restorejob_id"), F.col("db").alias("dest_dbname"), F.col("schema").alias("restoreschema"), F.col("worker").alias("bu_worker_id")),
        "dumpjob": df.select("id", F.col("worker").alias("worker_id"), F.col("worker").alias("pgsql_instance_id"), F.col("db").alias("dbname"), F.col("kind").alias("jobtype"), "cron",
                             F.col("n").cast("string").alias("restorejob_id")),
        "restorejob": df.select("id", F.col("worker").alias("dest_pgsql_instance_id"), F.col("db").alias("dest_dbname"), F.col("kind").alias("jobtype"), "cron", F.expr("id * 7 % 300").alias("catalog_id")),
        "worker": spark.range(3).select("id", F.lit("w").alias("dns_name")),
        "instance": spark.range(3).select("id", F.lit("i").alias("dns_name"), F.lit(1).alias("pgport")),
    }
    out = {}
    for name, rows_of in made.items():
        path = str(tmp_path_factory.mktemp("bases") / name)
        conform(rows_of, name).write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def build(table, b):
    return {
        "catalog": lambda: v.catalog_view(b["catalog"], b["worker"]), "restorelog": lambda: v.restorelog_view(b["restorelog"], b["worker"]),
        "dumpjob": lambda: v.dumpjob_view(b["dumpjob"], b["worker"], b["instance"]), "database": lambda: v.database_view(b["dumpjob"], b["instance"]),
        "restorejob": lambda: v.restorejob_view(b["restorejob"], b["instance"], b["catalog"], b["worker"]),
        "copyjob": lambda: v.copyjob_view(b["dumpjob"], b["restorejob"], b["instance"]),
    }[table]()


CASES = [(t, "jobid", j) for t in ("catalog", "restorelog", "dumpjob", "restorejob", "copyjob") for j in (7, 0)] + [
    (t, "jobid", j) for t in ("catalog", "restorelog") for j in ("%", "1_", "")] + [
    (t, "database", n) for t in ("catalog", "restorelog", "dumpjob", "database") for n in ("db1", "db1%", "d_1", "%", "db1.x", "a/b", "a", "", "\\%", "db\\%")] + [
    (t, "schedule", w) for t in ("dumpjob", "restorejob", "copyjob") for w in ("single", "R", "t", "x", "")]


@pytest.mark.parametrize("table,kind,value", CASES)
def test_same_rows(bases, table, kind, value):
    on_list = {"jobid": f.by_jobid, "database": f.by_database, "schedule": f.by_schedule}[kind]
    want = build(table, bases).filter(on_list(table, value))
    got = build(table, {**bases, **{t: bases[t].filter(c) for t, c in f.base_conditions(table, kind, value).items()}})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["db1", "d_1", "db1.x", "", "no such"])
def test_restores_of_a_database(bases, name):
    want = build("restorejob", bases).filter(f.by_database("restorejob", name))
    got = build("restorejob", {**bases, "restorejob": f.restores_of_database(bases["restorejob"], bases["catalog"], name)})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("table,kind,value,pushed", [
    ("catalog", "jobid", 7, "EqualTo(dumpjob_id,7)"), ("restorelog", "jobid", 7, "EqualTo(restorejob_id,7)"), ("copyjob", "jobid", 8, "EqualTo(id,8)"),
    ("catalog", "database", "db1%", "StringStartsWith(dbname,db1)"), ("restorelog", "database", "db1", "StringStartsWith(dest_dbname,db1)"),
    ("dumpjob", "database", "db1%", "StringStartsWith(dbname,db1)"), ("database", "database", "db1", "EqualTo(dbname,db1)"),
    ("dumpjob", "schedule", "single", "StringStartsWith(jobtype,S)"), ("restorejob", "schedule", "t", "StringStartsWith(jobtype,T)"), ("copyjob", "schedule", "s", "StringStartsWith(jobtype,S)"),
])
def test_conditions_reach_the_scan(spark, bases, table, kind, value, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    narrowed = {**bases, **{t: bases[t].filter(c) for t, c in f.base_conditions(table, kind, value).items()}}
    plan = build(table, narrowed)._jdf.queryExecution().executedPlan().toString()
    assert any("PushedFilters" in line and pushed in line for line in plan.splitlines()), plan


def test_unknown_filters():
    for table, kind in (("message", "jobid"), ("copyjob", "database"), ("catalog", "schedule"), ("catalog", "color")):
        with pytest.raises(f.UnknownFilter):
            f.base_conditions(table, kind, "x")
