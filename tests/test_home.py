"""Deduplicated snapshots, link counts, the dump path and cleans that stop anywhere."""

import datetime as dt
import itertools
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepsake.plans import clean, dump
from keepsake.plans.home import Home
from keepsake.sources import linkcounts, snapshots as sn, taskfiles, vault, versions
from keepsake.sources.schemas import conform

T0 = dt.datetime(2024, 1, 1, 3)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def tables(spark, extra=0):
    return {"public.a": spark.range(50).withColumn("v", F.col("id") * 2).coalesce(1), "public.b": spark.range(extra, extra + 5).coalesce(1)}


def rows_of(spark, home, path):
    out = {}
    for e in sn.read_manifest(spark, path).toLocalIterator():
        out[e["table_name"]] = sorted(r["id"] for r in vault.read_table(spark, path, home.store, e).collect())
    return out


def test_one_changed_table_stores_one_new_file(spark, tmp_path):
    home = Home(spark, str(tmp_path))
    shots = [sn.snapshot_write(spark, {"d": tables(spark, k)}, home.root, sn.DumpJob(1, "d"), T0 + dt.timedelta(days=k)) for k in (0, 1)]
    sizes = []
    for shot in shots:
        home.take_in(shot.path)
        home.take_in(shot.path)  # nothing more
        sizes.append(vault.blobs(spark, home.store).count())
        assert not os.path.exists(f"{shot.path}/data") and vault.is_complete(spark, shot.path)
    assert sizes == [2, 3]
    for k, shot in enumerate(shots):
        assert rows_of(spark, home, shot.path) == {"a": list(range(50)), "b": list(range(k, k + 5))}
        back = sn.snapshot_restore(spark, shot.path, sn.RestoreJob(1, str(tmp_path / "back"), f"d{k}"), dump.read_from(home))
        assert back.status == "COMPLETED" and spark.read.parquet(f"{back.path}/public.b").count() == 5
    assert {r["checksum"]: r["links"] for r in linkcounts.counts(spark, home.links).collect()}.keys() == {r["checksum"] for r in vault.blobs(spark, home.store).collect()}
    # sweeping: what the second one alone names stays; without any manifest nothing goes
    assert vault.sweep(spark, home.store, []) == 0
    assert vault.sweep(spark, home.store, [shots[1].path]) == 1
    assert rows_of(spark, home, shots[1].path) == {"a": list(range(50)), "b": list(range(1, 6))}


@pytest.mark.parametrize("stop", ["listed", "half moved", "moved"])
def test_taking_in_goes_on_where_it_stopped(spark, tmp_path, stop):
    home = Home(spark, str(tmp_path))
    shot = sn.snapshot_write(spark, {"d": tables(spark)}, home.root, sn.DumpJob(1, "d"), T0)
    vault.index(spark, shot.path)
    listed = sorted((r["path"], r["checksum"]) for r in vault.files(spark, shot.path).collect())
    for path, checksum in listed[:{"listed": 0, "half moved": 1, "moved": 2}[stop]]:
        taskfiles.move(path, f"{home.store}/{checksum[0]}/{checksum[1]}/{checksum}")
    home.take_in(shot.path)
    assert rows_of(spark, home, shot.path) == {"a": list(range(50)), "b": list(range(5))}
    assert vault.blobs(spark, home.store).count() == 2


def test_a_lost_content_is_noticed(spark, tmp_path):
    home = Home(spark, str(tmp_path))
    shot = sn.snapshot_write(spark, {"d": tables(spark)}, home.root, sn.DumpJob(1, "d"), T0)
    vault.index(spark, shot.path)
    taskfiles.delete(vault.files(spark, shot.path).first()["path"])
    with pytest.raises(FileNotFoundError):
        home.take_in(shot.path)
    assert os.path.exists(f"{shot.path}/data")


def test_link_counts_in_any_order(spark, tmp_path):
    path = str(tmp_path / "links")
    content = {f"d{k}": [f"{(k * 7 + i) % 11:032x}" for i in range(k + 3)] for k in range(4)}
    steps = [("add", d) for d in content] + [("remove", "d1"), ("remove", "d3"), ("add", "d0"), ("remove", "d3")]
    random.Random(3).shuffle(steps)
    for n, (what, name) in enumerate(steps):
        getattr(linkcounts, what)(spark.createDataFrame([(c,) for c in content[name]], "checksum string"), path, name)
        if n in (3, 6):
            linkcounts.fold(spark, path)
    want = Counter(itertools.chain(content["d0"], content["d2"]))
    assert {r["checksum"]: r["links"] for r in linkcounts.counts(spark, path).collect()} == want
    asked = spark.createDataFrame([(c,) for c in content["d3"] + content["d3"] + ["f" * 32]], "checksum string")
    got = {r["checksum"]: r["links"] for r in linkcounts.links_of(asked, path).collect()}
    assert got == {c: want.get(c, 0) for c in content["d3"] + ["f" * 32]}
    # a question reads the folders of its contents alone
    plan = linkcounts._rows(spark, path, ["00"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [p#" in plan.replace("isnotnull(p", "p")


def home_with_jobs(spark, tmp_path, **job):
    home = Home(spark, str(tmp_path))
    row = {"id": 1, "worker_id": 0, "pgsql_instance_id": 0, "dbname": "d", "keep_daily": 2, "keep_weekly": 0, "keep_monthly": 0, "keep_yearly": 0, **job}
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(
        f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in rows[0].items()))
    home.put("dumpjob", conform(frame([row]), "dumpjob"))
    home.put("worker", conform(frame([{"id": 0, "dns_name": "w"}]), "worker"))
    home.put("instance", conform(frame([{"id": 0, "dns_name": "p", "pgport": 5432}]), "instance"))
    home.put("restorejob", conform(frame([
        {"id": 5, "dest_pgsql_instance_id": 0, "dest_dbname": "copy", "existing_db": "RENAME", "jobtype": "SINGLE", "catalog_id": 99},
        {"id": 6, "dest_pgsql_instance_id": 0, "dest_dbname": "copy", "existing_db": "LEAVE", "jobtype": "TRIGGER", "catalog_id": 99}]), "restorejob"))
    return home


def column(home, table, name):
    return {r["id"]: r[name] for r in home.table(table).collect()}


def test_dump_path_and_job_states(spark, tmp_path):
    home = home_with_jobs(spark, tmp_path, jobtype="SINGLE", restorejob_id="5,6,77")
    root = str(tmp_path / "restored")
    done = dump.run_dump(home, {"d": tables(spark)}, 1, 100, T0, restore_root=root)
    assert (done.decision, done.status, [r.status for r in done.restored]) == ("RUN", "SUCCESS", ["COMPLETED", "ABORTED"])
    assert column(home, "dumpjob", "status") == {1: "HALTED"}
    assert column(home, "restorejob", "status") == {5: "HALTED", 6: "HALTED"}  # one has run, one found its destination there
    log = home.table("restorelog").collect()
    assert sorted((r["restorejob_id"], r["status"]) for r in log) == [(5, "COMPLETED"), (6, "ABORTED")]
    assert column(home, "catalog", "status") == {100: "SUCCESS"} and vault.is_complete(spark, done.snapshot)
    # the same run again goes on behind its catalog row, and finds all done
    again = dump.run_dump(home, {"d": tables(spark)}, 1, 100, T0, restore_root=root)
    assert again.status == "SUCCESS" and again.restored == [] and home.table("catalog").count() == 1
    # another run of a single job does not start
    assert dump.run_dump(home, {"d": tables(spark)}, 1, 101, T0).decision == "ALREADY_RUN"


def test_on_demand_flag(spark, tmp_path):
    home = home_with_jobs(spark, tmp_path)
    run = lambda n, **o: dump.run_dump(home, {"d": tables(spark)}, 1, n, T0 + dt.timedelta(days=n), on_demand=True, **o)
    assert run(1).decision == "RUN" and dump.flag_of(home, "d") == "SCHEDULE"
    dump.set_flag(home, "d", "YES")
    assert run(2).status == "SUCCESS" and dump.flag_of(home, "d") == "NO"
    assert run(3).decision == "ON_DEMAND_SKIP"
    said = home.table("message").collect()
    assert [(r["level"], r["jobid"], r["jobclass"]) for r in said] == [("INFO", 1, "DUMP")] and "TAKE_BACKUP=NO" in said[0]["message"]
    assert run(4, start_type="SINGLE").decision == "RUN"
    # a dump that fails leaves the flag and writes its row
    dump.set_flag(home, "d", "YES")
    failed = dump.run_dump(home, {"other": {}}, 1, 5, T0 + dt.timedelta(days=5), on_demand=True)
    assert failed.status == "FAILED" and dump.flag_of(home, "d") == "YES" and column(home, "catalog", "status")[5] == "FAILED"


@pytest.mark.parametrize("stop", [*clean.STEPS[:-1], None])
def test_clean_stopped_after_any_step(spark, tmp_path, stop):
    home = home_with_jobs(spark, tmp_path)
    shots = {}
    for n in range(4):
        shots[n] = dump.run_dump(home, {"d": tables(spark, min(n, 2))}, 1, n, T0 + dt.timedelta(days=n)).snapshot
    now = str(T0 + dt.timedelta(days=3, hours=5))
    if stop:
        clean.apply_clean(home, now, stop_after=stop)
    clean.apply_clean(home, now)
    left = column(home, "catalog", "status")
    assert set(left.values()) == {"SUCCESS"} and 3 in left and 0 not in left
    assert {n for n, p in shots.items() if os.path.exists(p)} == set(left)
    for n in left:
        assert rows_of(spark, home, shots[n]) == {"a": list(range(50)), "b": list(range(min(n, 2), min(n, 2) + 5))}
    linked = {r["checksum"] for r in linkcounts.counts(spark, home.links).collect()}
    assert linked == {r["checksum"] for r in vault.blobs(spark, home.store).collect()} and len(linked) == 1 + len({min(n, 2) for n in left})
    assert home.table("message").filter("tool = 'clean'").count() == (1 if stop != "rows" else 0)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, "id bigint").count() == 0
    versions.append(spark.range(2), path)
    for _ in range(3):
        versions.put(versions.read(spark, path, "id bigint").union(spark.range(1)), path)
    versions.append(spark.range(1), path)
    assert versions.read(spark, path, "id bigint").count() == 6 and len(versions.numbers(spark, path)) == 2


def test_damage_of_a_stored_snapshot_is_located(spark, tmp_path):
    home = Home(spark, str(tmp_path))
    shot = sn.snapshot_write(spark, {"d": tables(spark)}, home.root, sn.DumpJob(1, "d"), T0, keys={"public.a": "id"})
    assert shot.status == "SUCCESS"
    assert sn.damage(spark, shot.path).count() == 0
    home.take_in(shot.path)
    assert sn.damage(spark, shot.path, dump.read_from(home)).count() == 0
    # a bad disk: the content of table a with one other value and one row less
    row = vault.files(spark, shot.path).filter("table_path like '%public.a'").first()
    c = row["checksum"]
    bad = spark.range(49).withColumn("v", F.when(F.col("id") == 7, -1).otherwise(F.col("id") * 2)).coalesce(1)
    bad.write.parquet(str(tmp_path / "bad"))
    part = next(n for n in os.listdir(tmp_path / "bad") if n.endswith(".parquet"))
    blob = f"{home.store}/{c[0]}/{c[1]}/{c}".replace("file:", "")
    os.replace(tmp_path / "bad" / part, blob)
    spark.catalog.clearCache()
    found = sn.damage(spark, shot.path, dump.read_from(home)).collect()
    assert sorted((r["table_name"], r["first_key"], r["row_count"], r["found_count"]) for r in found) == [("public.a", 7, 1, 1), ("public.a", 49, 1, 0)]


def test_dumps_without_manifest_are_not_asked_for_one_by_one(spark, tmp_path, monkeypatch):
    home = home_with_jobs(spark, tmp_path, keep_daily=0)
    shot = sn.snapshot_write(spark, {"d": tables(spark)}, home.root, sn.DumpJob(1, "d"), T0)
    home.take_in(shot.path)
    place, name = shot.path.rsplit("/", 1)
    old = [(n, 1, T0, place, name if n == 1 else f"dump {n}%20_{n}", "SUCCESS", "NO") for n in range(1, 400)] + [(1, 1, T0, place, name, "SUCCESS", "NO")]
    home.put("catalog", conform(spark.createDataFrame(old, "id int, dumpjob_id int, starttime timestamp_ntz, bu_location string, bu_name string, status string, keep string"), "catalog"))
    asked = []
    exists = clean.vault.folders.exists
    monkeypatch.setattr(clean.vault.folders, "exists", lambda s, path: (asked.append(path), exists(s, path))[1])
    removed = clean.apply_clean(home, T0 + dt.timedelta(days=9))
    # a restore job names dump 99
    assert removed.count() == 399 and len(asked) < 50
    assert column(home, "catalog", "id") == {99: 99} and not os.path.exists(shot.path)
    assert vault.blobs(spark, home.store).count() == 0 and linkcounts.counts(spark, home.links).count() == 0
