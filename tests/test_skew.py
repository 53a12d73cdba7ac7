"""Hot keys: most rows in one group, results still whole and equal to a simple model."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from keepsake.operators import dedup, jobs, verify


def test_status_changes_with_a_hot_job(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        job = 1 if i % 3 else i % 50
        status = None if i % 17 == 0 else ["A", "B", "C"][(i * 7919) % 3]
        rows.append((job, base + dt.timedelta(minutes=(i * 37) % 4000), i, status))
    df = spark.createDataFrame(rows, "job_id int, at timestamp_ntz, event_id bigint, status string")
    want, last = set(), {}
    for job, at, event, status in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        old = last.get(job)
        if old is not None and status is not None and old != status:
            want.add((job, event, old, status))
        last[job] = status
    for ranges in (1, 8, 40):  # job 1 has two thirds of the rows and is cut into many ranges
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = jobs.status_changes(df).collect()
        assert {(r["job_id"], r["event_id"], r["old_status"], r["status"]) for r in got} == want and len(got) == len(want)


def test_dedup_with_a_hot_checksum(spark):
    rows = [(i, i % 7, f"p{i}", "hot" if i % 3 == 0 else f"c{i % 40}", 10 + i % 3 if i % 3 else 5) for i in range(2000)]
    files = spark.createDataFrame(rows, "file_id int, dump_id int, path string, checksum string, size int")
    store = spark.createDataFrame([("c1", 3), ("orphan", 9)], "checksum string, size int")
    first = defaultdict(lambda: 10**9)
    for f, _, _, c, _ in rows:
        first[c] = min(first[c], f)
    got = {r["file_id"]: r["action"] for r in dedup.dedup_classify(files, store).collect()}
    assert got == {f: "STORE" if first[c] == f and c != "c1" else "LINK" for f, _, _, c, _ in rows}
    after = dedup.store_update(files, store)
    assert after.count() == len(set(first) | {"c1", "orphan"})
    assert [r["checksum"] for r in dedup.orphan_blobs(files, store).collect()] == ["orphan"]
    lost_links = files.filter("checksum = 'hot'")
    assert dedup.orphan_blobs(lost_links, store).count() == 0  # no blob has a link: remove nothing
    gone = spark.createDataFrame([(d,) for d in range(7)], "dump_id int")
    assert dedup.orphan_after_remove(files, gone).count() == len(first)
    assert dedup.orphan_after_remove(files, gone.filter("dump_id < 6")).count() == 0


def test_store_write_is_foldered(spark, tmp_path):
    store = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("checksum"), F.lit(1).alias("size"))
    dedup.write_store(store, str(tmp_path / "store"))
    back = spark.read.option("basePath", str(tmp_path / "store")).parquet(str(tmp_path / "store"))
    assert back.count() == 300
    assert back.filter(F.substring("checksum", 1, 1) != F.col("p1").cast("string")).count() == 0


def test_verify_sample_is_exact(spark):
    rows = [(i, "FULL", "SUCCESS", "NO") for i in range(1003)] + [(5000, None, "SUCCESS", "NO"), (5001, "FULL", "SUCCESS", None), (5002, "CLUSTER", "SUCCESS", "NO")]
    df = spark.createDataFrame(rows, "id int, dumptype string, status string, verified string")
    for percent in (0, 1, 25, 50, 100):
        n = verify.verify_sample(df, percent, "s").count()
        assert n == int(1003 * percent / 100 + 0.5)
    ids = [{r["id"] for r in verify.verify_sample(df, 25, seed).collect()} for seed in ("s", "s", "t")]
    assert ids[0] == ids[1] != ids[2] and not ids[0] & {5000, 5001, 5002}
    small = {r["id"] for r in verify.verify_sample(df, 10, "s").collect()}
    assert small < ids[0]


def test_capped_start(spark):
    routed = spark.createDataFrame([(i, 100 + i, i % 2) for i in range(1000)], "restore_id int, catalog_id int, route_worker_id int")
    running = spark.createDataFrame([(0, 1), (1, 9)], "worker_id int, n int")
    assert [r["restore_id"] for r in jobs.capped_start(routed, running).collect()] == [0]
    assert jobs.capped_start(routed, running.filter("worker_id = 5"), 3).count() == 6


def test_copy_link_joins_ranges_in_order(spark):
    links = spark.range(5000).select(F.lit(1).alias("dumpjob_id"), F.col("id").cast("int").alias("restorejob_id"))
    row = jobs.copy_link(links.union(links)).first()
    assert row["restorejob_id"] == ",".join(str(i) for i in range(5000)) and row["status"] == "ACTIVE"
