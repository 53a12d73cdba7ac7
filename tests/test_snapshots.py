"""Take, check, restore and fan out snapshots; text round trips; streams that are run again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from keepsake.sources import snapshots as sn, textfiles as tf
from keepsake.streaming import uploads

START = dt.datetime(2024, 1, 5, 10, 15)


@pytest.fixture()
def databases(spark):
    a = spark.range(100).select(F.col("id").alias("k"), F.array(F.lit(1)).alias("arr"), F.create_map(F.lit("a"), "id").alias("m"))
    b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    return {"shop": {"public.a": a, "other.b": b}, "second": {"public.c": b}}


def take(spark, databases, root, **job):
    return sn.snapshot_write(spark, databases, str(root), sn.DumpJob(**{"id": 4, "dbname": "shop", **job}), START)


def test_full(spark, databases, tmp_path):
    rel = spark.createDataFrame([("public", 10, "r"), ("other", 5, "r"), ("public", 7, "v")], "table_schema string, total_bytes bigint, relkind string")
    shot = sn.snapshot_write(spark, databases, str(tmp_path), sn.DumpJob(4, "shop", comment="c"), START, relations=rel)
    row = shot.catalog_row.first()
    assert (row["status"], row["bu_name"], row["message"], row["dbsize"]) == ("SUCCESS", "4_shop_FULL_20240105T101500", "c", 15)
    assert row["dumpsize"] > 0 and row["keep"] == "AUTO" and row["verified"] == "NO"
    assert all(r["ok"] for r in sn.check_snapshot(spark, shot.path).collect())


def test_damage_is_found(spark, databases, tmp_path):
    shot = take(spark, databases, tmp_path)
    spark.createDataFrame([(1, "x"), (2, "changed")], "k int, v string").write.mode("overwrite").parquet(f"{shot.path}/data/shop/other.b")
    assert {r["table_name"]: r["ok"] for r in sn.check_snapshot(spark, shot.path).collect()} == {"public.a": True, "other.b": False}


def test_schema_and_one_namespace(spark, databases, tmp_path):
    shot = take(spark, databases, tmp_path, dumptype="SCHEMA", dumpschema="other")
    assert shot.path.endswith("4_shop.other/4_shop.other_SCHEMA_20240105T101500") and shot.status == "SUCCESS"
    assert [r["table_name"] for r in sn.read_manifest(spark, shot.path).collect()] == ["b"]
    done = sn.snapshot_restore(spark, shot.path, sn.RestoreJob(1, str(tmp_path / "d"), "new"))
    assert done.status == "COMPLETED" and spark.read.parquet(f"{done.path}/other.b").count() == 0


def test_cluster(spark, databases, tmp_path):
    shot = take(spark, databases, tmp_path, dumptype="CLUSTER")
    assert "/4_cluster.full/" in shot.path
    assert sn.snapshot_restore(spark, shot.path, sn.RestoreJob(1, str(tmp_path / "d"), "ignored")).status == "COMPLETED"
    assert spark.read.parquet(str(tmp_path / "d/second/public.c")).count() == 2


def test_failure_gives_a_failed_row(spark, databases, tmp_path):
    bad = {"shop": {"public.a": spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))}}
    for shot in (take(spark, bad, tmp_path), take(spark, databases, tmp_path, dumptype="SCRIPT", dumpoptions="nothing")):
        row = shot.catalog_row.first()
        assert (row["status"], row["dbsize"], row["dumpsize"]) == ("FAILED", -1, -1)
    with pytest.raises(ValueError):
        take(spark, databases, tmp_path, dumptype="DATA")


def test_script(spark, databases, tmp_path):
    @sn.script("totals")
    def totals(session, context):
        assert context.options == ["-v", "x"]
        return context.databases["shop"]["public.a"].agg(F.sum("k").alias("total"))

    shot = take(spark, databases, tmp_path, dumptype="SCRIPT", dumpoptions="totals -v x", dumpschema="other")
    assert shot.path.endswith("4_shop/4_shop_SCRIPT_20240105T101500")
    assert spark.read.parquet(f"{shot.path}/data/shop/script.totals").first()[0] == 4950


def test_restore_modes(spark, databases, tmp_path):
    shot, root = take(spark, databases, tmp_path), str(tmp_path / "dest")

    def restore(db="d", **k):
        return sn.snapshot_restore(spark, shot.path, sn.RestoreJob(1, root, db, **k)).status

    def count(path):
        return spark.read.parquet(f"{root}/{path}").count()

    spark.range(5).write.parquet(f"{root}/d/public.old")
    assert restore(existing_db="LEAVE") == "ABORTED"
    assert restore(existing_db="TRUNCATE") == "ERROR"  # staged, but the old one is in the way
    assert restore(existing_db="RENAME") == "COMPLETED"
    assert count("d/public.a") == 100 and count("d_rs_bak/public.old") == 5 and not os.path.exists(f"{root}/d/public.old")
    assert restore(existing_db="RENAME") == "COMPLETED"
    assert count("d_rs_bak/public.a") == 100 and not os.path.exists(f"{root}/d_rs_bak/public.old")
    assert restore(restoretype="DATA", existing_db="RENAME") == "COMPLETED" and count("d/public.a") == 200
    assert restore(restoretype="DATA", existing_db="TRUNCATE") == "COMPLETED" and count("d/public.a") == 100
    assert restore(restoreschema="public") == "ERROR"  # the table is there already
    assert restore(existing_db="DROP") == "COMPLETED" and restore(existing_db="DROP_BEFORE") == "COMPLETED"
    assert restore(restoretype="SCHEMA", existing_db="DROP") == "COMPLETED" and count("d/public.a") == 0
    assert restore(restoreschema="nowhere") == "ERROR"
    assert sorted(n for n in os.listdir(root) if not n.startswith(".")) == ["d", "d_rs_bak"]
    assert [n for n in os.listdir(root) if n.startswith(".d.")] == []
    back = spark.read.parquet(f"{root}/d_rs_bak/other.b")
    assert back.schema == spark.read.parquet(f"{shot.path}/data/shop/other.b").schema


def test_copy_and_log(spark, databases, tmp_path):
    shot = take(spark, databases, tmp_path)
    jobs = [sn.RestoreJob(i, str(tmp_path / "c"), f"c{i}") for i in (2, 1)]
    done = sn.snapshot_copy(spark, shot.path, jobs)
    log = sn.restore_log(spark, done, shot.path, START, START).collect()
    assert [(r["restorejob_id"], r["status"], r["src_dbname"]) for r in log] == [(2, "COMPLETED", "shop"), (1, "COMPLETED", "shop")]


def test_pipe_and_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'quote " here', True), (2, None, None)], "id int, t string, b boolean")
    path = str(tmp_path / "x.list")
    for _ in range(2):  # a second export replaces the first
        tf.export_pipe(df, path)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == ['1|quote " here|t', "2||"]
    assert [n for n in os.listdir(tmp_path) if n.startswith(".x")] == []
    tf.export_tsv(df.coalesce(1), str(tmp_path / "tsv"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "tsv")).collect()} >= {"id\tt\tb", "2\tNone\tNone", '1\tquote " here\tTrue'}


def test_file_inventory(spark, tmp_path, monkeypatch):
    from keepsake.sources import taskfiles

    monkeypatch.setattr(taskfiles, "PIECE_BYTES", 2)
    for folder in ("d", "with  blank", "100%20 per%", "ümlaut#?"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.dat.gz").write_bytes(b"hello")
    (tmp_path / "d" / "empty.dat.gz").write_bytes(b"")
    (tmp_path / "d" / "toc.dat").write_bytes(b"skip")
    rows = tf.file_inventory(spark, str(tmp_path)).collect()
    assert sorted((r["checksum"], r["size"]) for r in rows) == [("5d41402abc4b2a76b9719d911017c592", 5)] * 4 + [("d41d8cd98f00b204e9800998ecf8427e", 0)]
    assert any("/with blank/" in r["path"] for r in rows) and any("/100%20 per%/" in r["path"] for r in rows)


def test_files_of_other_stores_are_looked_up_by_their_store(monkeypatch):
    import io
    import types

    import pyarrow.fs

    from keepsake.sources import taskfiles

    seen = []
    system = types.SimpleNamespace(open_input_stream=lambda name, compression=None: (seen.append(name), io.BytesIO(b"abc"))[1])
    found = types.SimpleNamespace(from_uri=lambda uri: (seen.append(uri), (system, uri.split("://")[1]))[1])
    monkeypatch.setattr(pyarrow.fs, "FileSystem", found)
    assert b"".join(taskfiles.pieces("s3a://bucket/a b/100%.dat.gz")) == b"abc"
    assert seen == ["s3://bucket/", "bucket/a b/100%.dat.gz"]


GOOD = "20240101T000000+0100\tINFO\ttool\ttext\tDUMP\t-1\t4"


def test_stream_upload_counts_each_file_once(spark, tmp_path):
    spool, out, mark = str(tmp_path / "spool"), str(tmp_path / "out"), str(tmp_path / "mark")
    os.mkdir(spool)

    def put(name, *lines):
        open(f"{spool}/{name}", "w").write("\n".join(lines) + "\n")

    def run():
        uploads.stream_upload(spark, spool, out, mark, max_files=1).awaitTermination()

    put("1.tool.message.dat", GOOD, GOOD.replace("INFO", "NOTICE"), GOOD.replace("20240101", "20249901"))
    run()
    put("2.tool.message.dat", GOOD)
    put("3.notes.dat", "what is this")
    run()
    run()
    rows = spark.read.parquet(f"{out}/message").collect()
    assert len(rows) == 2 and {str(r["logtime"]) for r in rows} == {"2023-12-31 23:00:00"}
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert sorted(r["reason"] for r in rejects) == ["format", "target", "value"]


def test_data_restores_are_planned_direct(spark):
    from keepsake.operators import jobs

    job = "id int, catalog_id int, restoretype string, restoreschema string, existing_db string, restoreoptions string, role_handling string, tblspc_handling string"
    kinds = [(i, 1, kind, schema, existing, "", "USE_ROLE", "USE_TBLSPC") for i, (kind, schema, existing) in enumerate(
        (k, s, e) for k in ("FULL", "DATA", "SCHEMA") for s in ("*", "s1") for e in ("DROP", "RENAME", "LEAVE", "TRUNCATE"))]
    catalog = spark.createDataFrame([(1, "1_shop_FULL_x")], "id int, bu_name string")
    flags = spark.createDataFrame([(1, True)], "dump_id int, has_database boolean")
    got = {r["id"]: r for r in jobs.restore_plan(spark.createDataFrame(kinds, job), catalog, flags).collect()}
    for i, _, kind, schema, *_ in kinds:
        direct = kind == "DATA" or schema != "*"
        assert (got[i]["target"] == "DIRECT", got[i]["final_action"] == "NONE") == (direct, direct)


def test_row_hash_sees_nulls_change_places(spark):
    from keepsake.operators import verify

    df = spark.createDataFrame([(None, 5), (5, None)], "a int, b int")
    assert df.select(verify.content_parts(df, ["a", "b"])[0].alias("h")).distinct().count() == 2


def test_work_of_a_run_goes_at_its_end(spark, tmp_path):
    from keepsake import session
    from keepsake.sources import folders

    kept = session.settle(spark.range(3), "kept")
    with session.work_scope(spark):
        inner = session.settle(spark.range(5), "inner")
        inner.write.parquet(str(tmp_path / "out"))
        place = inner.inputFiles()[0].rsplit("/", 1)[0]
    assert not folders.exists(spark, place) and kept.count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 5
