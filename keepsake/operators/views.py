"""Report views over the catalog tables.

Every view is a plain projection or join. Dimension sides carry no broadcast
hint: Spark decides by their real size, statically and again at run time.
``ordered=True`` adds the view's own sort order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keepsake.functions import scalars as s
from keepsake.session import settle


def numbered(ordered: DataFrame, column: str = "position") -> DataFrame:
    """Rows of a sorted list with their place, from 1: the place inside a range of the sort, after the ranges before it.

    The list is written in its order first; what is added up has one row per range.
    """
    rows = settle(ordered.withColumn("_at", F.monotonically_increasing_id()), "sorted-list")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = settle(sizes.select("_part", before.alias("_before")), "list-ranges")
    placed = rows.join(starts, part == F.col("_part"))
    return placed.withColumn(column, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def _sorted(df: DataFrame, ordered: bool, keys: list[Column], columns: list[Column]) -> DataFrame:
    if ordered:
        df = df.orderBy(*keys)
    return df.select(*columns)


def _up(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def worker_view(worker: DataFrame, ordered: bool = False) -> DataFrame:
    return _sorted(
        worker, ordered, [_up("dns_name")],
        [
            F.col("id"), F.col("dns_name"), F.col("status"), F.col("cron_cacheconfig"),
            F.col("cron_singlejob"), F.col("cron_clean"), F.col("cron_upload"), F.col("comment"),
            s.null_default(F.col("restore_worker_id").cast("string"), "").alias("restore_worker_id"),
            s.fmt_time("date_added").alias("date_added"),
        ],
    )


def worker_plain_view(worker: DataFrame) -> DataFrame:
    return worker.select(
        "id", "dns_name", "comment", "cron_cacheconfig", "cron_singlejob", "cron_clean", "cron_upload"
    )


def message_view(message: DataFrame, ordered: bool = False) -> DataFrame:
    return _sorted(
        message, ordered, [_up("logtime"), _up("id")],
        [
            F.col("id"), F.col("level"), F.col("tool"), s.fmt_time("logtime").alias("logtime"),
            s.cut_text("message", 64).alias("message"), F.col("jobclass"), F.col("jobid"),
        ],
    )


def instance_plain_view(instance: DataFrame) -> DataFrame:
    return instance.select(
        "id", "dns_name", "pgport", "comment", "pgsql_superuser", "status", "bu_window_start",
        "bu_window_end", F.col("worker_id_default").alias("pgsql_worker_id_default"),
    )


def window_length_view(instance: DataFrame) -> DataFrame:
    return instance.select(
        "id", F.col("bu_window_start").alias("start_hour"),
        s.window_length("bu_window_start", "bu_window_end").cast("int").alias("length_min"),
    )


def catalog_view(catalog: DataFrame, worker: DataFrame, ordered: bool = False) -> DataFrame:
    w = worker.select(F.col("id").alias("w_id"), F.col("dns_name").alias("worker"))
    joined = catalog.join(w, F.col("w_id") == F.col("bu_worker_id"))
    return _sorted(
        joined, ordered, [F.col("starttime").asc_nulls_last(), _up("id")],
        [
            F.col("id"), s.host_port("pgsql_dns_name", "pgsql_port").alias("pgsql"),
            s.concat_null("dumpjob_id", F.lit("/"), s.db_schema("dbname", "dumpschema")).alias("id_db_schema"),
            F.col("dumptype"), s.fmt_time("starttime").alias("starttime"),
            s.duration("starttime", "endtime").alias("duration"), F.col("status"), F.col("verified"),
            F.col("keep"), s.cut_text("message", 32).alias("message"), F.col("worker"),
        ],
    )


def dumpjob_worker_instance(dumpjob: DataFrame, worker: DataFrame, instance: DataFrame) -> DataFrame:
    """Dump jobs with the names of their worker and instance; ``date_added`` is kept for J3."""
    w = worker.select(F.col("id").alias("w_id"), F.col("dns_name").alias("worker_dns_name"))
    p = instance.select(
        F.col("id").alias("p_id"), F.col("dns_name").alias("pgsql_instance_dns_name"),
        F.col("pgport").alias("pgsql_instance_port"),
        F.col("pgsql_superuser").alias("pgsql_instance_superuser"),
    )
    return (
        dumpjob.join(w, F.col("w_id") == F.col("worker_id"))
        .join(p, F.col("p_id") == F.col("pgsql_instance_id"))
        .drop("w_id", "p_id")
    )


def dumpjob_worker_instance_view(dumpjob: DataFrame, worker: DataFrame, instance: DataFrame) -> DataFrame:
    return dumpjob_worker_instance(dumpjob, worker, instance).select(
        "id", "worker_id", "pgsql_instance_id", "dbname", "dumptype", "dumpschema", "cron", "keep_daily",
        "keep_weekly", "keep_monthly", "keep_yearly", "comment", "status", "jobtype", "worker_dns_name",
        "pgsql_instance_dns_name", "pgsql_instance_port", "pgsql_instance_superuser", "restorejob_id",
        "dumpoptions",
    )


def dumpjob_view(
    dumpjob: DataFrame, worker: DataFrame, instance: DataFrame, ordered: bool = False
) -> DataFrame:
    joined = dumpjob_worker_instance(dumpjob, worker, instance)
    order = F.concat(s.lower_key("dbname"), F.lit("."), s.lower_key("dumpschema"))
    return _sorted(
        joined, ordered, [order.asc_nulls_last(), _up("id")],
        [
            F.col("id"), s.host_port("pgsql_instance_dns_name", "pgsql_instance_port", "\n").alias("pgsql"),
            F.col("dbname"), F.col("dumpschema").alias("schema"), F.col("dumptype").alias("type"),
            s.null_default("restorejob_id", "").alias("restorejob"),
            s.concat_null(s.cut_text("jobtype", 1), F.lit("/"), "cron").alias("schedule"),
            F.col("status"), s.cut_text("comment", 32).alias("comment"),
            F.col("worker_dns_name").alias("worker"),
            s.fmt_time("date_added", s.TWO_LINE_FORMAT).alias("date_added"),
        ],
    )


def instance_view(instance: DataFrame, worker: DataFrame, ordered: bool = False) -> DataFrame:
    w = worker.select(F.col("id").alias("w_id"), F.col("dns_name").alias("w_dns_name"))
    joined = instance.join(w, F.col("w_id") == F.col("worker_id_default"), "left")
    return _sorted(
        joined, ordered, [_up("dns_name"), _up("pgport")],
        [
            F.col("id"), F.col("dns_name"), F.col("pgport").alias("port"),
            F.col("pgsql_superuser").alias("superuser"), F.col("status"),
            F.col("bu_window_start").alias("hr_s"), F.col("bu_window_end").alias("hr_e"),
            s.concat_null("w_dns_name", F.lit(" ("), s.cut_text("def_jobstatus", 1), F.lit(")")).alias(
                "def_worker_addjobstatus"
            ),
            F.col("comment"), s.fmt_time("date_added").alias("date_added"),
        ],
    )


def restorejob_view(
    restorejob: DataFrame, instance: DataFrame, catalog: DataFrame, worker: DataFrame, ordered: bool = False
) -> DataFrame:
    p = instance.select(F.col("id").alias("p_id"), F.col("dns_name").alias("p_dns"), F.col("pgport").alias("p_port"))
    c = catalog.select(
        F.col("id").alias("c_id"), F.col("dbname").alias("c_db"), F.col("dumpschema").alias("c_schema"),
        F.col("bu_worker_id").alias("c_worker"),
    )
    w = worker.select(F.col("id").alias("w_id"), F.col("dns_name").alias("w_dns"))
    joined = (
        restorejob.join(p, F.col("p_id") == F.col("dest_pgsql_instance_id"))
        .join(c, F.col("c_id") == F.col("catalog_id"), "left")
        .join(w, F.col("w_id") == F.col("c_worker"), "left")
    )
    return _sorted(
        joined, ordered, [_up("c_db"), _up("id")],
        [
            F.col("id"), s.null_default(F.col("c_id").cast("string"), "N/A").alias("cat_id"),
            s.null_default(s.db_schema("c_db", "c_schema"), "N/A").alias("s_db_schema"),
            s.host_port("p_dns", "p_port", "\n").alias("d_pgsql"), F.col("dest_dbname").alias("d_dbname"),
            F.col("restoreschema").alias("d_rschema"), F.col("restoretype").alias("d_rtype"),
            F.col("restoreoptions").alias("options"), s.schedule_label("jobtype", "cron").alias("schedule"),
            F.col("status"), F.col("comment"), s.null_default("w_dns", "(trigger)").alias("worker"),
            s.fmt_time("date_added", s.TWO_LINE_FORMAT).alias("date_added"),
        ],
    )


def restorelog_view(restorelog: DataFrame, worker: DataFrame, ordered: bool = False) -> DataFrame:
    w = worker.select(F.col("id").alias("w_id"), F.col("dns_name").alias("w_dns"))
    joined = restorelog.join(w, F.col("w_id") == F.col("bu_worker_id"), "left")
    return _sorted(
        joined, ordered, [s.fmt_time("starttime").asc_nulls_last(), _up("id")],
        [
            F.col("id"), F.col("src_dbname").alias("s_dbname"),
            s.host_port("pgsql_dns_name", "pgsql_port", "\n").alias("d_pgsql"),
            s.concat_null("restorejob_id", F.lit("/"), "dest_dbname", F.lit("."), "restoreschema").alias(
                "id_db_schema"
            ),
            F.col("restoretype"), s.fmt_time("starttime", s.TWO_LINE_FORMAT).alias("starttime"),
            s.duration("starttime", "endtime").alias("duration"), F.col("status"),
            s.cut_text("message", 32).alias("message"), F.col("w_dns").alias("worker"),
        ],
    )


def restorejob_instance(restorejob: DataFrame, instance: DataFrame) -> DataFrame:
    p = instance.select(
        F.col("id").alias("p_id"), F.col("dns_name"), F.col("pgport"), F.col("pgsql_superuser"),
        F.col("status").alias("status_pgsqlinstance"),
    )
    return restorejob.join(p, F.col("p_id") == F.col("dest_pgsql_instance_id")).select(
        "id", "catalog_id", "dest_dbname", "restoretype", s.quote_ident("restoreschema").alias("restoreschema"),
        "restoreoptions", "existing_db", "cron", F.col("status").alias("status_restorejob"), "comment",
        "jobtype", "dns_name", "pgport", "pgsql_superuser", "role_handling", "tblspc_handling",
        "status_pgsqlinstance",
    )


def link_restore_catalog(restorelog: DataFrame, catalog: DataFrame) -> DataFrame:
    """Restore log rows with the dump they read, by full path.

    A restore of a cluster dump logs its path without the file ending while the
    catalog name keeps it, so such rows do not link. That is the view's rule.
    """
    logs = restorelog.select(F.col("id").alias("restorelog_id"), F.col("bu_path"))
    dumps = catalog.select(
        F.col("id").alias("catalog_id"), s.full_path("bu_location", "bu_name").alias("dump_path")
    )
    return logs.join(dumps, F.col("bu_path") == F.col("dump_path")).select("restorelog_id", "catalog_id")


def copy_links(dumpjob: DataFrame) -> DataFrame:
    """One row per (dump job, restore job id in its comma list)."""
    return dumpjob.withColumn("rjid", F.explode(s.id_list("restorejob_id")))


def _copyjobs(dumpjob: DataFrame, restorejob: DataFrame, instance: DataFrame) -> DataFrame:
    # The destination is the restore job's own instance.
    def side(prefix: str) -> DataFrame:
        return instance.select(
            F.col("id").alias(prefix + "_id"), F.col("dns_name").alias(prefix + "_dns"),
            F.col("pgport").alias(prefix + "_port"),
        )

    d = copy_links(dumpjob).select(
        F.col("id").alias("did"), "dbname", "dumpschema", "dumptype",
        s.concat_null(s.cut_text("jobtype", 1), F.lit("/"), "cron").alias("schedule"),
        F.col("status").alias("dstatus"), F.col("comment").alias("d_comment"), "date_added",
        "pgsql_instance_id", "rjid",
    )
    r = restorejob.select(
        F.col("id").alias("rid"), "dest_pgsql_instance_id", "dest_dbname", "restoreschema", "restoretype",
        F.col("status").alias("rstatus"), F.col("comment").alias("r_comment"),
    )
    return (
        d.join(r, F.col("rid") == F.col("rjid"))
        .join(side("src"), F.col("src_id") == F.col("pgsql_instance_id"))
        .join(side("dst"), F.col("dst_id") == F.col("dest_pgsql_instance_id"))
    )


def copyjob_view(
    dumpjob: DataFrame, restorejob: DataFrame, instance: DataFrame, ordered: bool = False
) -> DataFrame:
    return _sorted(
        _copyjobs(dumpjob, restorejob, instance), ordered,
        [_up("dbname"), _up("src_dns"), _up("src_port"), _up("did"), _up("rid")],
        [
            F.col("did"), s.host_port("src_dns", "src_port", "\n").alias("s_pgsql"),
            s.db_schema("dbname", "dumpschema").alias("s_db_schema"), F.col("dumptype").alias("s_dtype"),
            F.col("schedule"), F.col("dstatus"), F.col("rid"),
            s.host_port("dst_dns", "dst_port", "\n").alias("d_pgsql"),
            s.db_schema("dest_dbname", "restoreschema").alias("d_db_schema"),
            F.col("restoretype").alias("d_rtype"), F.col("rstatus"),
            s.fmt_time("date_added", s.TWO_LINE_FORMAT).alias("date_added"),
        ],
    )


def copyjob_detail(
    dumpjob: DataFrame, restorejob: DataFrame, instance: DataFrame, ordered: bool = False
) -> DataFrame:
    return _sorted(
        _copyjobs(dumpjob, restorejob, instance), ordered, [_up("did"), _up("rid")],
        [
            F.col("did").alias("id"), F.col("rid"), s.host_port("src_dns", "src_port").alias("src_pgsql_instance"),
            F.col("dbname").alias("src_dbname"), F.col("dumpschema").alias("src_schema"),
            F.col("dumptype").alias("dtype"), F.col("schedule"), F.col("dstatus"),
            s.null_default("d_comment", "").alias("dcomment"),
            s.host_port("dst_dns", "dst_port").alias("dest_pgsql_instance"), F.col("dest_dbname"),
            F.col("restoreschema").alias("dest_schema"), F.col("restoretype").alias("rtype"), F.col("rstatus"),
            s.null_default("r_comment", "").alias("rcomment"),
        ],
    )


def database_view(dumpjob: DataFrame, instance: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct databases. Grouping is on the full time, so equal-looking dates may repeat."""
    p = instance.select(F.col("id").alias("p_id"), "dns_name", "pgport")
    rows = (
        dumpjob.select("dbname", "date_added", "pgsql_instance_id")
        .distinct()
        .join(p, F.col("p_id") == F.col("pgsql_instance_id"))
        .select("dbname", "dns_name", "pgport", "date_added")
        .distinct()
    )
    return _sorted(
        rows, ordered, [s.lower_key("dbname").asc_nulls_last()],
        [
            F.col("dbname"), F.col("dns_name"), F.col("pgport"),
            s.fmt_time("date_added", s.DATE_FORMAT).alias("date_added"),
        ],
    )
