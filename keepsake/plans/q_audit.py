"""Registered queries: validation and integrity reports."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as s
from keepsake.operators import audit
from keepsake.plans.registry import query

CATALOG_LINE = """cast(dumpjob_id as string) || chr(9) || strftime(starttime, '%Y%m%dT%H%M%S') || '+0000' || chr(9)
  || strftime(endtime, '%Y%m%dT%H%M%S') || '+0000' || chr(9) || status || chr(9) || bu_name || chr(9) || bu_location || chr(9)
  || cast(dbsize as string) || chr(9) || cast(dumpsize as string) || chr(9) || dbname || chr(9) || dumpschema || chr(9)
  || dumptype || chr(9) || bu_extension || chr(9) || pgversion || chr(9) || cast(bu_worker_id as string) || chr(9)
  || coalesce(message, '') || chr(9) || pgsql_dns_name || chr(9) || cast(pgsql_port as string)"""


def catalog_lines(catalog):
    """Catalog rows as tab-separated upload lines."""
    fields = [
        F.col("dumpjob_id"), s.compact_stamp("starttime"), s.compact_stamp("endtime"), "status", "bu_name", "bu_location",
        "dbsize", "dumpsize", "dbname", "dumpschema", "dumptype", "bu_extension", "pgversion", "bu_worker_id",
        F.coalesce("message", F.lit("")), "pgsql_dns_name", "pgsql_port",
    ]
    cells = [s.col(x).cast("string") for x in fields]
    line = F.concat(*[part for i, x in enumerate(cells) for part in ([F.lit("\t"), x] if i else [x])])
    return catalog.select("id", line.alias("line"))


@query("validate_message", r"""select line_no, regexp_matches(line, '^\d{8}T\d{6}[+-]\d+\t((INFO|WARNING|ERROR|CRITICAL|DEBUG))\t.+\t.*\t((CACHE_CONFIG|DUMP|RESTORE|VERIFY|DEDUP|CLEAN))\t-?\d+\t\d+$') as valid
from fx_upload""")
def _message(m):
    return audit.validate(m.upload, "message").select("line_no", "valid")


@query("validate_catalog", rf"""select id, regexp_matches(line, '^\d+\t\d{{8}}T\d{{6}}[+-]\d+\t\d{{8}}T\d{{6}}[+-]\d+\t[A-Z]+\t[a-zA-Z0-9_\.\/-]+\t[a-zA-Z0-9_\.\/-]+\t-?\d+\t-?\d+\t.*\t.*\t.*\t.*\t.*\t\d+\t.*\t.*\t\d+$') as valid
from (select id, case when id % 41 = 0 then replace({CATALOG_LINE}, chr(9), ' ') else {CATALOG_LINE} end as line from fx_catalog)""")
def _catalog(m):
    lines = catalog_lines(m.catalog).withColumn(
        "line", F.when(F.col("id") % 41 == 0, F.replace("line", F.lit("\t"), F.lit(" "))).otherwise(F.col("line")))
    return audit.validate(lines, "catalog").select("id", "valid")


def _in(table, column, words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"select '{table}' as table_name, cast(id as bigint) as id, '{table}_{column}_check' as rule from fx_{table} where not ({column} in ({listed}))"


def _match(table, column, pattern):
    return f"select '{table}', id, '{table}_{column}_check' from fx_{table} where not regexp_matches({column}, '{pattern}')"


@query("check_audit", "\nunion all ".join(
    [_in(t, c, w) for t, cs in audit.ALLOWED.items() for c, w in cs.items()]
    + [_match(t, c, p) for t, cs in audit.PATTERNS.items() for c, p in cs.items()]))
def _check(m):
    return audit.check_audit({t: getattr(m, t) for t in ("worker", "instance", "dumpjob", "catalog", "restorejob")})


@query("fk_audit", "\nunion all ".join(
    f"select '{t}' as table_name, '{c}' as key_column, cast(id as bigint) as id, cast({c} as bigint) as value from fx_{t} where {c} is not null and {c} not in (select id from fx_{p})"
    for t, c, p in audit.FOREIGN_KEYS))
def _fk(m):
    return audit.fk_audit({t: getattr(m, t) for t in ("worker", "instance", "dumpjob", "catalog", "restorejob", "restorelog")})


@query("unique_audit", """
with doubled_worker as (select id, dns_name from fx_worker union all select id + 100, dns_name from fx_worker where status = 'ACTIVE')
select 'worker' as table_name, 'id' as key_columns, cast(id as string) as key_value, count(*) as row_count from doubled_worker group by id having count(*) > 1
union all select 'worker', 'dns_name', dns_name, count(*) from doubled_worker group by dns_name having count(*) > 1
union all select 'instance', 'id', cast(id as string), count(*) from fx_instance group by id having count(*) > 1
union all select 'instance', 'dns_name,pgport', dns_name || '|' || pgport, count(*) from fx_instance group by dns_name, pgport having count(*) > 1
union all select 'dumpjob', 'id', cast(id as string), count(*) from fx_dumpjob group by id having count(*) > 1
union all select 'catalog', 'id', cast(id as string), count(*) from fx_catalog group by id having count(*) > 1
union all select 'message', 'id', cast(id as string), count(*) from fx_message group by id having count(*) > 1""")
def _unique(m):
    again = m.worker.filter("status = 'ACTIVE'").withColumn("id", F.col("id") + 100)
    return audit.unique_audit({
        "worker": m.worker.unionByName(again), "instance": m.instance, "dumpjob": m.dumpjob, "catalog": m.catalog,
        "message": m.message})


@query("delete_cascade", """
with gone as (select id from fx_restorejob where status = 'HALTED')
select 'restorejob' as table_name, id from fx_restorejob where id not in (select id from gone)
union all select 'restorelog', id from fx_restorelog where restorejob_id not in (select id from gone)""")
def _cascade(m):
    jobs, logs = audit.delete_cascade(m.restorejob, m.restorelog, m.restorejob.filter("status = 'HALTED'"))
    return jobs.select(F.lit("restorejob").alias("table_name"), "id").unionByName(
        logs.select(F.lit("restorelog").alias("table_name"), "id"))
