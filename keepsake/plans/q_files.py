"""Registered queries that write files and read them again."""

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keepsake.functions import scalars as s
from keepsake.operators import extract, retention, verify
from keepsake.plans.q_audit import catalog_lines
from keepsake.plans.q_extract import ACL
from keepsake.plans.q_retention import KEEP
from keepsake.plans.registry import NOW, query
from keepsake.session import work_dir
from keepsake.sources import folders, snapshots as sn, textfiles as tf
from keepsake.sources.schemas import TABLES, conform

START = dt.datetime(2001, 3, 30, 12, 0, 0)


@query("export_pipe", """select id, worker_id, pgsql_instance_id, dbname, dumptype, dumpschema, coalesce(dumpoptions, '') as dumpoptions, keep_daily,
  keep_weekly, keep_monthly, keep_yearly, comment, cron, status, jobtype, coalesce(restorejob_id, '') as restorejob_id, date_added from fx_dumpjob""")
def _pipe(m):
    path = work_dir(m.spark, "pipe") + "/dumpjobs.list"
    tf.export_pipe(conform(m.dumpjob, "dumpjob"), path)
    return tf.read_pipe(m.spark, path, TABLES["dumpjob"])


@query("export_tsv", "select id, bu_name, coalesce(message, 'None') as message, dbsize from fx_catalog")
def _tsv(m):
    path = work_dir(m.spark, "tsv")
    tf.export_tsv(m.catalog.select("id", "bu_name", "message", "dbsize"), path)
    parts = F.split("value", "\t")
    rows = m.spark.read.text(path).filter("value <> 'id\tbu_name\tmessage\tdbsize'")
    return rows.select(*[F.get(parts, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(
        [("id", "int"), ("bu_name", "string"), ("message", "string"), ("dbsize", "bigint")])])


@query("file_inventory", """select 'dump of ' || source || ' 100%/data' as place, md5(string_agg(text || chr(10), '' order by doc_id)) as checksum,
  cast(sum(strlen(text) + 1) as bigint) as size from documents group by source""")
def _inventory(m):
    """Every document as a line of its source's file, in folders with blanks and ``%`` in their names; the files are then read."""
    base = work_dir(m.spark, "inventory")
    docs = m.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("dump  of "), "source", F.lit(" 100%")).alias("at"))
    for row in docs.select("at").distinct().toLocalIterator():
        lines = docs.filter(F.col("at") == row["at"]).repartition(1).sortWithinPartitions("doc_id").select("text")
        lines.write.text(f"{base}/{row['at']}/data")
    found = tf.file_inventory(m.spark, base, "part-*")
    return found.select(F.regexp_extract("path", "([^/]+/data)/part-[^/]*$", 1).alias("place"), "checksum", "size")


def write_spool(m) -> str:
    """A spool with messages, catalog rows and an entry of no known kind."""
    spool = work_dir(m.spark, "spool")
    m.upload.select("line").write.text(f"{spool}/1.message.dat")
    catalog_lines(m.catalog).select("line").write.text(f"{spool}/2.catalog.dat")
    m.region.select("r_name").write.text(f"{spool}/3.notes.dat")
    return spool


@query("upload_route", """select 'message' as target, count(*) as n, count(distinct line) as lines from fx_upload
union all select 'catalog', count(*), count(*) from fx_catalog union all select 'unknown', count(*), count(*) from region""")
def _route(m):
    return tf.read_spool(m.spark, write_spool(m)).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("lines"))


VALID = r"regexp_matches(line, '^\d{8}T\d{6}[+-]\d+\t((INFO|WARNING|ERROR|CRITICAL|DEBUG))\t.+\t.*\t((CACHE_CONFIG|DUMP|RESTORE|VERIFY|DEDUP|CLEAN))\t-?\d+\t\d+$')"
PARSED = f"""select strptime(substr(line, 1, 15), '%Y%m%dT%H%M%S') as logtime, split_part(line, chr(9), 2) as level, split_part(line, chr(9), 3) as tool,
  split_part(line, chr(9), 4) as message, split_part(line, chr(9), 5) as jobclass, cast(split_part(line, chr(9), 6) as int) as jobid,
  split_part(line, chr(9), 7) as bu_worker_id from fx_upload where {VALID}"""


@query("upload_load", f"""select cast(null as int) as id, * from ({PARSED})""")
def _load(m):
    out = work_dir(m.spark, "messages")
    rows, _ = tf.load_upload(m.upload, "message")
    conform(rows, "message").write.mode("append").parquet(out)
    return m.spark.read.parquet(out)


def databases(m) -> dict[str, sn.Tables]:
    return {"shop": {"public.orders": m.orders, "public.customer": m.customer, "stock.part": m.part}}


def take(m, **job) -> sn.Snapshot:
    shot = sn.snapshot_write(m.spark, databases(m), work_dir(m.spark, "snapshots"), sn.DumpJob(**{"id": 7, "dbname": "shop", **job}), START)
    if shot.status != "SUCCESS":
        raise RuntimeError(shot.catalog_row.first()["message"])
    return shot


@query("snapshot_write", """
select 'public.orders' as table_name, count(*) as row_count, cast(sum(o_orderkey) as bigint) as key_sum, 'SUCCESS' as status, '7_shop_FULL_20010330T120000' as bu_name, true as ok from orders
union all select 'public.customer', count(*), cast(sum(c_custkey) as bigint), 'SUCCESS', '7_shop_FULL_20010330T120000', true from customer
union all select 'stock.part', count(*), cast(sum(p_partkey) as bigint), 'SUCCESS', '7_shop_FULL_20010330T120000', true from part""")
def _write(m):
    shot = take(m)
    keys = {"public.orders": "o_orderkey", "public.customer": "c_custkey", "stock.part": "p_partkey"}
    again = reduce(DataFrame.unionByName, [
        m.spark.read.parquet(f"{shot.path}/data/shop/{t}").agg(F.sum(k).alias("key_sum")).select(F.lit(t).alias("t"), "key_sum")
        for t, k in keys.items()])
    checked = sn.check_snapshot(m.spark, shot.path)
    manifest = sn.read_manifest(m.spark, shot.path).select(s.concat_null("schema_name", F.lit("."), "table_name").alias("name"), "row_count")
    return (
        manifest.join(again, F.col("t") == F.col("name")).join(checked, F.col("table_name") == F.col("name"))
        .join(shot.catalog_row.select("status", "bu_name"), F.lit(True))
        .select("table_name", "row_count", "key_sum", "status", "bu_name", "ok")
    )


# Every table as (key, words, amount), so that rows of all of them are one result.
ROWS = {
    "public.orders": ("o_orderkey", "o_orderstatus || '|' || o_orderpriority", "o_totalprice", "orders"),
    "public.customer": ("c_custkey", "c_name || '|' || c_mktsegment", "c_acctbal", "customer"),
    "stock.part": ("p_partkey", "p_name || '|' || p_brand || '|' || p_type", "p_retailprice", "part"),
}


def all_rows(m, place: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        m.spark.read.parquet(f"{place}/{t}").select(F.lit(t).alias("table_name"), F.col(k).alias("key"), F.expr(words).alias("words"), F.col(a).alias("amount"))
        for t, (k, words, a, _) in ROWS.items()])


@query("snapshot_restore", "\nunion all ".join(
    f"select '{t}' as table_name, {k} as key, {words} as words, {a} as amount from {source}" for t, (k, words, a, source) in ROWS.items()))
def _restore(m):
    shot, dest = take(m), work_dir(m.spark, "restored")
    m.region.write.parquet(f"{dest}/shop2/public.old")
    done = sn.snapshot_restore(m.spark, shot.path, sn.RestoreJob(1, dest, "shop2", existing_db="RENAME"))
    if done.status != "COMPLETED":
        raise RuntimeError(done.message)
    return all_rows(m, f"{dest}/shop2")


@query("snapshot_copy", "\nunion all ".join(
    f"select '{d}' as dest, '{t}' as table_name, " + (f"count(*) as row_count, cast(sum({k}) as bigint) as key_sum from {source}" if d != "c" else "0 as row_count, null as key_sum")
    for d in "abc" for t, (k, _, _, source) in ROWS.items() if d != "b" or t.startswith("public.")))
def _copy(m):
    shot, dest = take(m), work_dir(m.spark, "copies")
    jobs = [sn.RestoreJob(1, dest, "a"), sn.RestoreJob(2, dest, "b", restoreschema="public"), sn.RestoreJob(3, dest, "c", restoretype="SCHEMA")]
    for done in sn.snapshot_copy(m.spark, shot.path, jobs):
        if done.status != "COMPLETED":
            raise RuntimeError(done.message)
    return reduce(DataFrame.unionByName, [
        m.spark.read.parquet(f"{dest}/{d}/{t}").agg(F.count(F.lit(1)).alias("row_count"), F.sum(ROWS[t][0]).alias("key_sum"))
        .select(F.lit(d).alias("dest"), F.lit(t).alias("table_name"), "row_count", "key_sum")
        for d in "abc" for t in folders.names(m.spark, f"{dest}/{d}")])


@query("verify_schema", """select 'public.orders' as table_name, true as ok, count(*) as row_count from orders
union all select 'public.customer', true, count(*) from customer union all select 'stock.part', true, count(*) from part""")
def _schema(m):
    shot = take(m)
    parts = []
    for e in sn.read_manifest(m.spark, shot.path).toLocalIterator():
        found = m.spark.read.parquet(f"{shot.path}/{e['path']}")
        ok = verify.schema_matches(e["schema_json"], found)
        parts.append(found.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(f"{e['schema_name']}.{e['table_name']}").alias("table_name"), F.lit(ok).alias("ok"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


@sn.script("orders_by_priority")
def _by_priority(spark, context):
    orders = context.databases[context.job.dbname]["public.orders"]
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query("script_job", "select o_orderpriority, count(*) as orders from orders group by o_orderpriority")
def _script(m):
    shot = take(m, dumptype="SCRIPT", dumpoptions="orders_by_priority -v")
    return m.spark.read.parquet(f"{shot.path}/data/shop/script.orders_by_priority")


@query("table_functions", f"""with recursive {KEEP} select 'keep_ids' as function, cast(id as string) as value from keep_ids
union all select 'acl_roles', acl_role from (select distinct acl_role from ({ACL}) where acl_role <> '')""")
def _functions(m):
    keep = retention.keep_set(m.catalog, m.dumpjob, m.restorejob, NOW)
    return keep.select(F.lit("keep_ids").alias("function"), F.col("id").cast("string").alias("value")).unionByName(
        extract.acl_roles(m.acl).select(F.lit("acl_roles").alias("function"), F.col("role").alias("value")))
