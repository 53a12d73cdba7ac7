"""Column types of the catalog tables, as DDL text, and the default values.

Enumerations are plain strings; :mod:`keepsake.operators.audit` holds their rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TABLES: dict[str, str] = {
    "catalog": (
        "id int, dumpjob_id int, starttime timestamp_ntz, endtime timestamp_ntz, status string, "
        "bu_name string, bu_location string, dbsize bigint, dumpsize bigint, dbname string, "
        "dumpschema string, dumptype string, verified string, keep string, bu_extension string, "
        "pgversion string, bu_worker_id int, message string, pgsql_dns_name string, pgsql_port int"
    ),
    "worker": (
        "id int, dns_name string, comment string, cron_cacheconfig string, cron_singlejob string, "
        "cron_clean string, cron_upload string, status string, date_added timestamp_ntz, "
        "restore_worker_id int"
    ),
    "dumpjob": (
        "id int, worker_id int, pgsql_instance_id int, dbname string, dumptype string, "
        "dumpschema string, dumpoptions string, keep_daily int, keep_weekly int, keep_monthly int, "
        "keep_yearly int, comment string, cron string, status string, jobtype string, "
        "restorejob_id string, date_added timestamp_ntz"
    ),
    "restorejob": (
        "id int, dest_pgsql_instance_id int, dest_dbname string, restoretype string, "
        "restoreschema string, restoreoptions string, existing_db string, status string, "
        "comment string, jobtype string, cron string, catalog_id int, role_handling string, "
        "tblspc_handling string, date_added timestamp_ntz"
    ),
    "instance": (
        "id int, dns_name string, pgport int, comment string, pgsql_superuser string, status string, "
        "bu_window_start int, bu_window_end int, worker_id_default int, date_added timestamp_ntz, "
        "def_jobstatus string"
    ),
    "message": (
        "id int, level string, tool string, logtime timestamp_ntz, message string, jobclass string, "
        "jobid int, bu_worker_id string"
    ),
    "restorelog": (
        "id int, restorejob_id int, starttime timestamp_ntz, endtime timestamp_ntz, status string, "
        "bu_path string, message string, bu_worker_id int, pgsql_dns_name string, pgsql_port int, "
        "dest_dbname string, restoreschema string, restoretype string, src_dbname string"
    ),
    "activity": (
        "id bigint, starttime timestamp_ntz, worker_id int, process_id int, command_line string"
    ),
    "setting": "id int, key string, value string",
    "script": "id int, scriptname string, scriptcode string, date_added timestamp_ntz",
    "metainfo": "key string, val string",
}

# Column defaults of the catalog tables.
DEFAULTS: dict[str, dict[str, object]] = {
    "catalog": {"verified": "NO", "keep": "AUTO"},
    "worker": {
        "cron_cacheconfig": "15 20 * * *",
        "cron_singlejob": "* * * * *",
        "cron_clean": "15 18 * * *",
        "cron_upload": "*/5 * * * *",
        "status": "ACTIVE",
    },
    "dumpjob": {
        "dumptype": "FULL",
        "dumpschema": "*",
        "keep_daily": 14,
        "keep_weekly": 2,
        "keep_monthly": 5,
        "keep_yearly": 2,
        "status": "ACTIVE",
        "jobtype": "REPEAT",
    },
    "restorejob": {
        "restoretype": "FULL",
        "restoreschema": "*",
        "restoreoptions": "",
        "existing_db": "RENAME",
        "status": "ACTIVE",
        "jobtype": "SINGLE",
        "cron": "* * * * *",
        "role_handling": "USE_ROLE",
        "tblspc_handling": "NO_TBLSPC",
    },
    "instance": {
        "pgsql_superuser": "postgres",
        "status": "ACTIVE",
        "bu_window_start": 2,
        "bu_window_end": 6,
        "def_jobstatus": "INHERIT",
    },
    "restorelog": {"status": "RUNNING"},
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def column_names(name: str) -> list[str]:
    return [column.split()[0] for column in TABLES[name].split(", ")]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring rows to the table's columns: cast what is there, default what is not.

    This is also how an older version of a table is read: a column added later
    comes out with its default value.
    """
    present = set(df.columns)
    defaults = DEFAULTS.get(name, {})
    return df.select(
        *[
            (
                F.col(f.name) if f.name in present else F.lit(defaults.get(f.name))
            ).cast(f.dataType).alias(f.name)
            for f in schema_of(name).fields
        ]
    )
