"""Dump and restore jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from keepsake.functions import scalars as s
from keepsake.session import settle

# Schedule that means "as soon as possible", comment of found databases,
# comment of generated restore jobs, limit of restores at a time.
RUN_NOW = "* * * * *"
AUTO_COMMENT = "auto added dump job"
SERVER_RESTORE_COMMENT = "generated server restore job"
MAX_PARALLEL_RESTORE = 2
START_TYPES = ("CRON", "SINGLE", "TRIGGER")


def dumpjob_defaults(new_jobs: DataFrame, instance: DataFrame, seed: Column) -> DataFrame:
    """New jobs with a seeded schedule where none is given and the instance's default worker."""
    p = instance.select(
        F.col("id").alias("p_id"), F.col("bu_window_start").alias("p_start"),
        F.col("bu_window_end").alias("p_end"), F.col("worker_id_default").alias("p_worker"),
    )
    joined = new_jobs.join(p, F.col("p_id") == F.col("pgsql_instance_id"), "left")
    return joined.withColumns({
        "cron": F.coalesce(F.nullif("cron", F.lit("")), s.random_cron(seed, "p_start", "p_end")),
        "worker_id": F.coalesce("worker_id", "p_worker"),
    }).drop("p_id", "p_start", "p_end", "p_worker")


def scheduled_jobs(job_view: DataFrame, worker_id: int | None = None, instance_id: int | None = None) -> DataFrame:
    """Jobs that a worker keeps in its schedule list, by id; only ACTIVE ones are ``scheduled``."""
    rows = job_view.filter(F.col("cron") != RUN_NOW)
    if worker_id is not None:
        rows = rows.filter(F.col("worker_id") == worker_id)
    if instance_id is not None:
        rows = rows.filter(F.col("pgsql_instance_id") == instance_id)
    return rows.withColumn("scheduled", F.col("status") == "ACTIVE").orderBy("id")


def run_now_jobs(job_view: DataFrame, worker_id: int | None = None, id_pattern: str = "%") -> DataFrame:
    rows = job_view.filter(
        (F.col("jobtype") == "SINGLE") & (F.col("status") == "ACTIVE") & (F.col("cron") == RUN_NOW)
        & F.col("id").cast("string").like(id_pattern)
    )
    return rows if worker_id is None else rows.filter(F.col("worker_id") == worker_id)


def lookup(table: DataFrame, keys: DataFrame, on: list[str], value: Column, name: str) -> DataFrame:
    """(lookup, key, value) for all asked keys at once; a key that is not there has a null value."""
    asked = keys.select(*[F.col(c).alias("k_" + c) for c in on]).distinct()
    found = table.select(*[F.col(c).alias("t_" + c) for c in on], value.cast("string").alias("value"))
    same = reduce(lambda a, b: a & b, [F.col("k_" + c) == F.col("t_" + c) for c in on])
    key = F.concat_ws("|", *[F.col("k_" + c).cast("string") for c in on])
    return asked.join(found, same, "left").select(F.lit(name).alias("lookup"), key.alias("key"), "value")


def key_exists(table: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """(lookup, key, value): '1' for a key that the table holds, else '0'."""
    asked = keys.select(F.col(column).alias("k")).filter(F.col("k").isNotNull()).distinct()
    found = table.select(F.col("id").alias("t"))
    return asked.join(found, F.col("k") == F.col("t"), "left").select(
        F.lit(name).alias("lookup"), F.col("k").cast("string").alias("key"),
        F.when(F.col("t").isNull(), F.lit("0")).otherwise(F.lit("1")).alias("value"),
    )


def _routed(restorejob: DataFrame, catalog: DataFrame, worker: DataFrame) -> DataFrame:
    c = catalog.select(F.col("id").alias("c_id"), "bu_name", "starttime", "bu_worker_id")
    w = worker.select(F.col("id").alias("w_id"), "restore_worker_id")
    return (
        restorejob.join(c, F.col("c_id") == F.col("catalog_id"))
        .join(w, F.col("w_id") == F.col("bu_worker_id"))
        .withColumn("route_worker_id", F.coalesce("restore_worker_id", "bu_worker_id"))
    )


def restore_routing(
    restorejob: DataFrame, catalog: DataFrame, worker: DataFrame, run_now: bool = False,
    worker_id: int | None = None, id_pattern: str = "%",
) -> DataFrame:
    """Restore jobs with the worker that has to run them: scheduled ones or run-now ones."""
    if run_now:
        jobs = restorejob.filter(
            (F.col("status") == "ACTIVE") & (F.col("jobtype") == "SINGLE") & (F.col("cron") == RUN_NOW)
            & F.col("id").cast("string").like(id_pattern)
        )
    else:
        jobs = restorejob.filter(F.col("cron") != RUN_NOW)
    rows = _routed(jobs, catalog, worker)
    if worker_id is not None:
        rows = rows.filter(F.col("route_worker_id") == worker_id)
    return rows.select(
        F.col("id").alias("restore_id"), "catalog_id", "cron", "bu_name", "starttime", "dest_dbname",
        "restoreschema", "restoretype", "restoreoptions", "route_worker_id",
    )


def pending_counts(run_now_dumps: DataFrame, run_now_restores: DataFrame) -> DataFrame:
    """(worker_id, jobclass, pending)."""
    dumps = run_now_dumps.select("worker_id", F.lit("DUMP").alias("jobclass"))
    restores = run_now_restores.select(F.col("route_worker_id").alias("worker_id"), F.lit("RESTORE").alias("jobclass"))
    return dumps.unionByName(restores).groupBy("worker_id", "jobclass").agg(F.count(F.lit(1)).alias("pending"))


def capped_start(routed: DataFrame, running: DataFrame, max_parallel: int = MAX_PARALLEL_RESTORE) -> DataFrame:
    """The first restores each worker may start next to those already ``running(worker_id, n)``.

    The constant bound on the rank lets every task drop all but ``max_parallel`` rows per
    worker before the shuffle.
    """
    rank = Window.partitionBy("route_worker_id").orderBy("restore_id")
    first = routed.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= max_parallel)
    r = running.select(F.col("worker_id").alias("r_worker"), F.col("n").alias("r_n"))
    free = F.greatest(F.lit(max_parallel) - F.coalesce("r_n", F.lit(0)), F.lit(0))
    return (
        first.join(r, F.col("r_worker") == F.col("route_worker_id"), "left")
        .filter(F.col("place") <= free).select("restore_id", "catalog_id", "route_worker_id")
    )


def discover_databases(
    discovered: DataFrame, dumpjob: DataFrame, instance: DataFrame, worker_id: int | None = None,
    auto_status: str = "ACTIVE",
) -> DataFrame:
    """New dump jobs for databases that have none on their ACTIVE instance."""
    seen = discovered.filter(~F.col("datistemplate") & F.col("datallowconn"))
    p = instance.filter(F.col("status") == "ACTIVE")
    if worker_id is not None:
        p = p.filter(F.col("worker_id_default") == worker_id)
    p = p.select(F.col("id").alias("i_id"), F.col("def_jobstatus"))
    known = dumpjob.select(F.col("pgsql_instance_id").alias("k_instance"), F.col("dbname").alias("k_db"))
    fresh = seen.join(p, F.col("i_id") == F.col("pgsql_instance_id")).join(
        known, (F.col("k_instance") == F.col("pgsql_instance_id")) & (F.col("k_db") == F.col("datname")), "left_anti"
    )
    rows = fresh.select(
        "pgsql_instance_id", F.col("datname").alias("dbname"), F.lit(AUTO_COMMENT).alias("comment"),
        F.when(F.col("def_jobstatus") == "INHERIT", F.lit(auto_status)).otherwise(F.col("def_jobstatus")).alias("status"),
        F.lit(None).cast("string").alias("cron"), F.lit(None).cast("int").alias("worker_id"),
    )
    return dumpjob_defaults(rows, instance, F.concat_ws("/", F.col("pgsql_instance_id").cast("string"), F.col("dbname")))


def effective_status(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Live status where it is known, else the cached one, else ACTIVE; ``changed`` against the cache."""
    c = cached.select(F.col("id").alias("c_id"), F.col("status").alias("c_status"))
    l = live.select(F.col("id").alias("l_id"), F.col("status").alias("l_status"))
    before = F.coalesce("c_status", F.lit("ACTIVE"))
    after = F.coalesce(F.col("l_status"), before)
    return c.join(l, F.col("c_id") == F.col("l_id"), "full").select(
        F.coalesce("c_id", "l_id").alias("id"), after.alias("status"), (after != before).alias("changed")
    )


def latest_dump_per_db(catalog: DataFrame, maintenance_db: str = "postgres") -> DataFrame:
    """Newest whole, successful, kept dump of every database of every server.

    A maximum over (start, id) combines before the shuffle, so one server or database
    with most of the dumps is no hot group.
    """
    rows = catalog.filter(
        (F.col("status") == "SUCCESS") & F.col("keep").isin("AUTO", "YES") & (F.col("dumptype") == "FULL")
        & (F.col("dumpschema") == "*") & ~F.col("dbname").like(maintenance_db)
    )
    return rows.groupBy("pgsql_dns_name", "pgsql_port", "dbname").agg(
        F.max(F.struct("starttime", "id", "bu_worker_id")).alias("last")
    ).select(
        "pgsql_dns_name", "pgsql_port", F.col("last.id").alias("cat_id"),
        F.col("last.bu_worker_id").alias("worker_id"), "dbname", F.col("last.starttime").alias("st"),
    )


def latest_dump_join(latest: DataFrame, catalog: DataFrame) -> DataFrame:
    """The full catalog rows of the latest dumps."""
    ids = latest.select(F.col("cat_id"))
    return catalog.join(ids, F.col("id") == F.col("cat_id")).drop("cat_id")


def _compared(batches):
    """Changes inside one range of rows that are in order, and the first and the last row of the range."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        whole = table if last is None else pa.concat_tables([last, table])
        before, after = whole.slice(0, whole.num_rows - 1), whole.slice(1)
        same = pc.equal(before["job_id"], after["job_id"])
        changed = pc.fill_null(pc.and_(same, pc.not_equal(before["status"], after["status"])), False)
        found = after.append_column("old_status", before["status"]).append_column("place", pa.array([1] * after.num_rows, pa.int8())).filter(changed)
        if last is None:
            found = pa.concat_tables([_edge(table.slice(0, 1), 0), found])
        yield from found.to_batches()
        last = table.slice(table.num_rows - 1)
    if last is not None:
        yield from _edge(last, 2).to_batches()


def _edge(row, place: int):
    import pyarrow as pa

    return row.append_column("old_status", pa.array([None], pa.string())).append_column("place", pa.array([place], pa.int8()))


def status_changes(history: DataFrame) -> DataFrame:
    """(job_id, at, event_id, old_status, status) wherever a job's status differs from the one before.

    ``history(job_id, at, event_id, status)``. Null on either side is no change.

    The rows are cut into even ranges of (job, at, event), so that any number of rows of one job,
    in one hour too, spreads over tasks. A range is compared row by row as it passes, and the
    first row of each range with the last row of the range before it: two rows a range.
    """
    columns = ["job_id", "at", "event_id", "status"]
    order = ["job_id", "at", "event_id", "status"]
    known = history.select(*columns).filter(F.col("job_id").isNotNull())
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields)
    ranged = known.repartitionByRange(*order).sortWithinPartitions(*order)
    compared = ranged.mapInArrow(_compared, f"{kind}, old_status string, place byte")
    found = settle(compared.withColumn("part", F.spark_partition_id()), "status-ranges")
    # two rows a range
    edges = found.filter("place <> 1")
    before = Window.orderBy("part", "place")
    crossing = edges.withColumn("old_job", F.lag("job_id").over(before)).withColumn("old_status", F.lag("status").over(before)).filter(
        (F.col("place") == 0) & (F.col("old_job") == F.col("job_id")) & (F.col("old_status") != F.col("status")))
    out = ["job_id", "at", "event_id", "old_status", "status"]
    return found.filter("place = 1").select(*out).unionByName(crossing.select(*out))


def status_messages(changes: DataFrame, dumpjob: DataFrame, instance: DataFrame) -> DataFrame:
    """The message row of each status change of a known dump job."""
    j = dumpjob.select(F.col("id").alias("j_id"), "pgsql_instance_id", "dbname", "dumpschema")
    p = instance.select(F.col("id").alias("p_id"), s.host_port("dns_name", "pgport").alias("p_name"))
    rows = changes.join(j, F.col("j_id") == F.col("job_id")).join(p, F.col("p_id") == F.col("pgsql_instance_id"), "left")
    text = s.concat_null(
        F.lit("dump job: "), "p_name", F.lit("/"), "dbname", F.lit("."), "dumpschema",
        F.lit(" - job id: "), "job_id", F.lit(" - status: "), "status",
    )
    return rows.select(
        F.lit("INFO").alias("level"), F.lit("catalog_db").alias("tool"), F.col("at").alias("logtime"),
        text.alias("message"), F.lit("CACHE_CONFIG").alias("jobclass"), F.col("job_id").alias("jobid"),
        F.lit("-1").alias("bu_worker_id"),
    )


def running_activity(ops: DataFrame) -> DataFrame:
    """Runs that started and did not end: the last operation per (worker, process) is a START."""
    last = ops.groupBy("worker_id", "process_id").agg(F.max(F.struct("at", "seq", "op")).alias("last"))
    return last.filter(F.col("last.op") == "START").select(
        "worker_id", "process_id", F.col("last.at").alias("starttime"), F.col("last.seq").alias("seq")
    )


def dump_eligibility(
    dumpjob: DataFrame, worker: DataFrame, instance: DataFrame, flags: DataFrame,
    start_type: str = "CRON", on_demand: bool = False,
) -> DataFrame:
    """(id, decision): may the dump run? ``flags(dbname, val)`` holds the on-demand flag per database.

    A repeating job that is halted still runs when it is started by hand.
    """
    w = worker.select(F.col("id").alias("w_id"), F.col("status").alias("w_status"))
    p = instance.select(F.col("id").alias("p_id"), F.col("status").alias("p_status"))
    f = flags.select(F.col("dbname").alias("f_db"), "val")
    rows = (
        dumpjob.join(w, F.col("w_id") == F.col("worker_id")).join(p, F.col("p_id") == F.col("pgsql_instance_id"))
        .join(f, F.col("f_db") == F.col("dbname"), "left")
    )
    asked = F.lit(on_demand and start_type != "SINGLE")
    decision = (
        F.when(F.col("w_status") == "HALTED", F.lit("QUIT"))
        .when(F.col("p_status") == "HALTED", F.lit("ABANDON"))
        .when((F.col("jobtype") == "SINGLE") & (F.col("status") == "HALTED"), F.lit("ALREADY_RUN"))
        .when(asked & (F.col("val") == "NO"), F.lit("ON_DEMAND_SKIP"))
        .otherwise(F.lit("RUN"))
    )
    return rows.select("id", decision.alias("decision"))


def restore_eligibility(
    restorejob: DataFrame, instance: DataFrame, catalog: DataFrame, databases: DataFrame, start_type: Column
) -> DataFrame:
    """(id, decision, reason): may the restore run? ``databases(pgsql_instance_id, datname)`` exist already."""
    p = instance.select(F.col("id").alias("p_id"), F.col("status").alias("p_status"))
    jobs = restorejob.join(p, F.col("p_id") == F.col("dest_pgsql_instance_id"))
    c = catalog.select(F.col("id").alias("c_id"), F.col("status").alias("c_status"))
    d = databases.select(F.col("pgsql_instance_id").alias("d_instance"), F.col("datname").alias("d_db")).distinct()
    rows = jobs.join(c, F.col("c_id") == F.col("catalog_id"), "left").join(
        d, (F.col("d_instance") == F.col("dest_pgsql_instance_id")) & (F.col("d_db") == F.col("dest_dbname")), "left"
    ).withColumn("start", start_type)
    steps = [
        (~F.col("start").isin(*START_TYPES), "ERROR", "wrong start type"),
        ((F.col("existing_db") == "LEAVE") & F.col("d_db").isNotNull(), "ABORTED", "database is already present"),
        (F.col("p_status") == "HALTED", "ERROR", "instance is inactive"),
        ((F.col("start") == "CRON") & (F.col("status") != "ACTIVE"), "ERROR", "job is on halt"),
        (F.coalesce(F.col("c_status") != "SUCCESS", F.lit(True)), "ERROR", "dump does not exist or failed"),
    ]
    decision, reason = F.lit("RUN"), F.lit("")
    for test, word, why in reversed(steps):
        decision = F.when(test, F.lit(word)).otherwise(decision)
        reason = F.when(test, F.lit(why)).otherwise(reason)
    return rows.select("id", decision.alias("decision"), reason.alias("reason"))


def restore_plan(restorejob: DataFrame, catalog: DataFrame, flags: DataFrame) -> DataFrame:
    """How a restore runs. ``flags(dump_id, has_database, ...)`` come from the table of contents.

    ``direct``: straight into the destination, else staged and moved in place at the end. A
    restore of data only never touches the database itself, so it is direct.
    """
    c = catalog.select(F.col("id").alias("c_id"), "bu_name")
    t = flags.select(F.col("dump_id").alias("t_id"), "has_database")
    rows = restorejob.join(c, F.col("c_id") == F.col("catalog_id")).join(t, F.col("t_id") == F.col("catalog_id"), "left")
    sql = F.col("bu_name").rlike(s.EXTENSION_PATTERN)
    direct = ~F.coalesce("has_database", F.lit(False)) | (F.col("restoreschema") != "*") | (F.col("restoretype") == "DATA")
    options = F.array_join(
        F.array_compact(
            F.array(
                F.nullif(F.col("restoreoptions"), F.lit("")),
                F.when(~sql & (F.col("restoretype") == "DATA"), F.lit("--data-only")),
                F.when(~sql & (F.col("restoretype") == "SCHEMA"), F.lit("--schema-only")),
                F.when(~sql & (F.col("role_handling") == "NO_ROLE"), F.lit("--no-owner --no-privileges")),
                F.when(~sql & (F.col("tblspc_handling") == "NO_TBLSPC"), F.lit("--no-tablespaces")),
            )
        ),
        " ",
    )
    final = (
        F.when(sql | direct, F.lit("NONE"))
        .when(F.col("existing_db") == "DROP", F.lit("DROP_AND_MOVE"))
        .when(F.col("existing_db") == "RENAME", F.lit("RENAME_AND_MOVE"))
        .otherwise(F.lit("MOVE"))
    )
    return rows.select(
        "id", F.when(sql, F.lit("SQL")).otherwise(F.lit("DIR")).alias("mode"),
        F.when(~sql, F.when(direct, F.lit("DIRECT")).otherwise(F.lit("STAGED"))).alias("target"),
        options.alias("options"), final.alias("final_action"),
    )


def server_restore(latest: DataFrame, routes: DataFrame) -> DataFrame:
    """Restore jobs for all latest dumps of source servers; ``routes(src_dns_name, src_port, dest_instance_id)``."""
    r = routes.select("src_dns_name", "src_port", "dest_instance_id")
    rows = latest.join(r, (F.col("src_dns_name") == F.col("pgsql_dns_name")) & (F.col("src_port") == F.col("pgsql_port")))
    return rows.select(
        F.col("dest_instance_id").alias("dest_pgsql_instance_id"), F.col("dbname").alias("dest_dbname"),
        F.lit("FULL").alias("restoretype"), F.lit("*").alias("restoreschema"), F.lit("").alias("restoreoptions"),
        F.lit("LEAVE").alias("existing_db"), F.lit(SERVER_RESTORE_COMMENT).alias("comment"),
        F.lit("SINGLE").alias("jobtype"), F.lit(RUN_NOW).alias("cron"), F.col("cat_id").alias("catalog_id"),
        F.lit("USE_ROLE").alias("role_handling"), F.lit("USE_TBLSPC").alias("tblspc_handling"),
    )


def copy_link(links: DataFrame) -> DataFrame:
    """(id, restorejob_id, status): each dump job with the comma list of its restore jobs, made ACTIVE.

    The list is one text value of the dump job. Ids are joined to text in ranges first, so
    that what comes together at the end is one text per range and not one row per id.
    """
    ids = links.select(F.col("dumpjob_id").alias("id"), "restorejob_id").distinct()
    ranges = ids.groupBy("id", F.floor(F.col("restorejob_id") / 1000).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("restorejob_id")), lambda x: x.cast("string")), ",").alias("part")
    )
    whole = F.transform(F.array_sort(F.collect_list(F.struct("range", "part"))), lambda x: x["part"])
    return ranges.groupBy("id").agg(F.array_join(whole, ",").alias("restorejob_id")).withColumn("status", F.lit("ACTIVE"))


END_COLUMNS = [
    "endtime", "status", "message", "bu_path", "bu_worker_id", "pgsql_dns_name", "pgsql_port", "dest_dbname",
    "restoreschema", "restoretype", "src_dbname",
]


def restore_log_upsert(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Restore log from start rows ``(id, restorejob_id, starttime, bu_path)`` and end rows ``(id, seq, ...)``.

    A start row is RUNNING until an end row of its id comes; the last end row wins. A
    plain number as path is a catalog id.
    """
    last = ends.groupBy(F.col("id").alias("e_id")).agg(F.max(F.struct("endtime", "seq", *END_COLUMNS[1:])).alias("e"))
    joined = starts.join(last, F.col("id") == F.col("e_id"), "left")
    ended = F.col("e_id").isNotNull()
    path = F.col("e.bu_path")
    named = F.when(path.rlike("^[0-9]+$"), F.concat(F.lit("cat_id="), path)).otherwise(path)
    rest = [F.col("e." + c).alias(c) for c in END_COLUMNS if c not in ("status", "bu_path")]
    return joined.select(
        "id", "restorejob_id", "starttime",
        F.when(ended, F.col("e.status")).otherwise(F.lit("RUNNING")).alias("status"),
        F.when(ended, named).otherwise(F.col("bu_path")).alias("bu_path"), *rest,
    )
