"""Registered queries that run dumps and cleans over a home and read what is there afterwards."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from keepsake.plans import clean, dump
from keepsake.plans.home import Home
from keepsake.plans.q_files import databases
from keepsake.plans.q_retention import FREE, ROOT
from keepsake.plans.registry import NOW, query
from keepsake.session import settle, work_dir
from keepsake.sources import linkcounts, snapshots as sn, vault

KEYS = {"public.orders": "o_orderkey", "public.customer": "c_custkey", "stock.part": "p_partkey"}


def sums(tables: dict[str, DataFrame], *labels) -> DataFrame:
    """(table_name, row_count, key_sum) of tables, with labels in front."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(KEYS[name]).alias("key_sum")).select(
            *labels, F.lit(name).alias("table_name"), "row_count", "key_sum")
        out = row if out is None else out.unionByName(row)
    return out


@query("dump_path", """with t as (
  select 'public.orders' as table_name, count(*) as row_count, cast(sum(o_orderkey) as bigint) as key_sum, false as changed from orders
  union all select 'public.customer', count(*), cast(sum(c_custkey) as bigint), true from customer
  union all select 'stock.part', count(*), cast(sum(p_partkey) as bigint), false from part)
select d as dump, 'store' as place, table_name, row_count, key_sum, d = 1 or changed as stored from t, (select unnest([1, 2]) d)
union all select d, 'restored', table_name, row_count, key_sum, null from t, (select unnest([1, 2]) d)""")
def _dump(m):
    """Two dumps of one job, the second with one changed table, each restored by the job's restore job."""
    home = Home(m.spark, work_dir(m.spark, "home"))
    able = (F.col("dumptype") == "FULL") & (F.col("dumpschema") == "*") & (F.col("jobtype") == "REPEAT")
    jobs = settle(m.dumpjob, "dumpjobs")
    ready = jobs.filter(able).join(m.worker.filter("status = 'ACTIVE'").select(F.col("id").alias("w")), F.col("w") == F.col("worker_id")).join(
        m.instance.filter("status = 'ACTIVE'").select(F.col("id").alias("i")), F.col("i") == F.col("pgsql_instance_id"))
    job_id, dbname = ready.select(F.min(F.struct("id", "dbname"))).first()[0]
    restores = settle(m.restorejob, "restorejobs")
    restore_id = restores.filter("restoretype = 'FULL' and restoreschema = '*' and existing_db = 'RENAME'").agg(F.min("id")).first()[0]
    home.put("dumpjob", jobs.withColumn("restorejob_id", F.when(F.col("id") == job_id, F.lit(str(restore_id))).otherwise(F.col("restorejob_id"))))
    for name in ("worker", "instance", "restorejob"):
        home.put(name, getattr(m, name))
    # the restore job is to run for both dumps
    home.set_value("restorejob", restore_id, "jobtype", "TRIGGER")
    tables = databases(m)["shop"]
    later = {**tables, "public.customer": m.customer.withColumn("c_acctbal", F.col("c_acctbal") + 1)}
    out, known = None, m.spark.createDataFrame([], "checksum string")
    for number, state in ((1, tables), (2, later)):
        at = dt.datetime.fromisoformat(NOW) + dt.timedelta(days=number)
        done = dump.run_dump(home, {dbname: state}, job_id, 10 ** 6 + number, at, restore_root=f"{home.base}/restored")
        if (done.decision, done.status, [r.status for r in done.restored]) != ("RUN", "SUCCESS", ["COMPLETED"]):
            raise RuntimeError(str(done))
        fresh = vault.files(m.spark, done.snapshot).join(known, "checksum", "left_anti").select(F.regexp_extract("table_path", "[^/]+$", 0).alias("t")).distinct()
        fresh = settle(fresh, "fresh")
        entries = {f"{e['schema_name']}.{e['table_name']}": e for e in sn.read_manifest(m.spark, done.snapshot).toLocalIterator()}
        stored = sums({t: vault.read_table(m.spark, done.snapshot, home.store, e) for t, e in entries.items()}, F.lit(number).alias("dump"), F.lit("store").alias("place"))
        stored = stored.join(fresh, F.col("t") == F.col("table_name"), "left").withColumn("stored", F.col("t").isNotNull()).drop("t")
        back = {t: m.spark.read.parquet(f"{done.restored[0].path}/{t}") for t in entries}
        restored = sums(back, F.lit(number).alias("dump"), F.lit("restored").alias("place")).withColumn("stored", F.lit(None).cast("boolean"))
        # what is there now is asked now: the next dump replaces it
        both = settle(stored.unionByName(restored), "dumped")
        out = both if out is None else out.unionByName(both)
        known = settle(vault.blobs(m.spark, home.store).select("checksum"), "known")
    return out


DUMP_OF = "cast(substr(source, 4) as int) % 6 * 5 + 1"


def with_data(m, home: Home) -> DataFrame:
    """The catalog below the home's root, and six of its dumps with the documents as their data."""
    moved = lambda c: F.regexp_replace(c, f"^{ROOT}", home.root)
    catalog = settle(m.catalog.withColumn("bu_location", moved("bu_location")), "catalog")
    docs = m.documents.withColumn("dump", F.expr(DUMP_OF))
    places = docs.select("dump").distinct().join(catalog.select("id", "bu_location", "bu_name"), F.col("dump") == F.col("id"))
    for row in places.toLocalIterator():  # six
        path = f"{row['bu_location']}/{row['bu_name']}"
        docs.filter(F.col("dump") == row["dump"]).drop("dump").write.parquet(f"{path}/data/d/public.document")
        home.take_in(path)
    home.put("catalog", catalog)
    for name in ("dumpjob", "restorejob"):
        home.put(name, getattr(m, name))
    home.put("restorelog", m.restorelog.withColumn("bu_path", moved("bu_path")))
    return places


@query("clean_apply", f"""with recursive {FREE},
docs as (select {DUMP_OF} as id, count(*) as n from documents group by 1),
said as (select count(*) as n from free)
select c.id, c.status, d.n as data_rows, (select n from said) as removed from fx_catalog c left join docs d on d.id = c.id where c.id not in (select id from free)""")
def _clean(m):
    """The catalog after a clean, with the rows that the dumps left in the store still give."""
    home = Home(m.spark, work_dir(m.spark, "home"))
    places = with_data(m, home)
    clean.apply_clean(home, NOW)
    told = home.table("message").filter("tool = 'clean'").agg(F.max(F.regexp_extract("message", r"removed (\d+) dumps", 1).cast("bigint"))).first()[0]
    left = None
    for row in places.toLocalIterator():
        path = f"{row['bu_location']}/{row['bu_name']}"
        if not vault.is_complete(m.spark, path):
            continue
        named = vault.files(m.spark, path).select(F.concat(F.lit(home.store + "/"), F.substring("checksum", 1, 1), F.lit("/"), F.substring("checksum", 2, 1), F.lit("/"), "checksum").alias("p"))
        data = m.spark.read.parquet(*[r["p"] for r in named.toLocalIterator()]).agg(F.count(F.lit(1)).alias("data_rows")).select(F.lit(row["id"]).alias("d_id"), "data_rows")
        left = data if left is None else left.unionByName(data)
    held = vault.blobs(m.spark, home.store).select("checksum").join(linkcounts.counts(m.spark, home.links), "checksum", "left_anti")
    if held.limit(1).count():
        raise RuntimeError("contents are left that nothing links")
    rows = home.table("catalog").select("id", "status").withColumn("removed", F.lit(told))
    if left is None:
        return rows.withColumn("data_rows", F.lit(None).cast("bigint"))
    return rows.join(left, F.col("d_id") == F.col("id"), "left").drop("d_id")
