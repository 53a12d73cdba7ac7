"""Registered queries: dump and restore jobs."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keepsake.functions import scalars as s
from keepsake.operators import extract, jobs as j, views as v
from keepsake.plans.q_views import JWI
from keepsake.plans.registry import query

CRON = """cast(({m}) % 60 as string) || ' ' || cast(({m}) // 60 as string) || ' * * *'"""
MINUTE = """((i.bu_window_start * 60 + cast('0x' || substr(md5({seed}), 1, 8) as bigint) %
  ((i.bu_window_end - i.bu_window_start + 24) % 24 * 60 + 1)) % 1440)"""
SEED = "cast(d.pgsql_instance_id as string) || '/' || d.datname"
RND = CRON.format(m=MINUTE.format(seed=SEED))


@query("dumpjob_defaults", f"""select d.pgsql_instance_id, d.datname as dbname,
  coalesce(nullif(case when d.datistemplate then '0 1 * * *' when d.datallowconn then '' end, ''), {RND}) as cron,
  coalesce(case when d.datistemplate then 3 end, i.worker_id_default) as worker_id
from fx_discovered d left join fx_instance i on i.id = d.pgsql_instance_id""")
def _defaults(m):
    new = m.discovered.select(
        "pgsql_instance_id", F.col("datname").alias("dbname"),
        F.when(F.col("datistemplate"), "0 1 * * *").when(F.col("datallowconn"), "").alias("cron"),
        F.when(F.col("datistemplate"), 3).alias("worker_id"))
    return j.dumpjob_defaults(new, m.instance, F.concat_ws("/", F.col("pgsql_instance_id").cast("string"), "dbname"))


@query("scheduled_jobs", f"select id, worker_id, pgsql_instance_id, dbname, cron, status = 'ACTIVE' as scheduled from ({JWI}) where cron <> '* * * * *'")
def _scheduled(m):
    return j.scheduled_jobs(v.dumpjob_worker_instance_view(m.dumpjob, m.worker, m.instance)).select(
        "id", "worker_id", "pgsql_instance_id", "dbname", "cron", "scheduled")


@query("run_now_jobs", f"select id, worker_id, dbname from ({JWI}) where cron = '* * * * *' and jobtype = 'SINGLE' and status = 'ACTIVE'")
def _run_now(m):
    return j.run_now_jobs(v.dumpjob_worker_instance_view(m.dumpjob, m.worker, m.instance)).select("id", "worker_id", "dbname")


@query("point_lookups", """
select 'instance_name' as lookup, cast(k.id as string) as key, p.dns_name || ':' || p.pgport as value
  from (select distinct pgsql_instance_id as id from fx_dumpjob) k left join fx_instance p on p.id = k.id
union all select 'default_worker', cast(k.id as string), cast(p.worker_id_default as string)
  from (select distinct dest_pgsql_instance_id as id from fx_restorejob) k left join fx_instance p on p.id = k.id
union all select 'def_jobstatus', cast(k.id as string), p.def_jobstatus
  from (select distinct pgsql_instance_id as id from fx_discovered) k left join fx_instance p on p.id = k.id
union all select 'instance_id', k.dns_name || '|' || k.pgport, cast(p.id as string)
  from (select distinct dns_name, pgport from fx_instance) k left join fx_instance p on p.dns_name = k.dns_name and p.pgport = k.pgport
union all select 'worker_id', dns_name, cast(id as string) from fx_worker
union all select 'cron_clean', cast(k.id as string), w.cron_clean
  from (select distinct worker_id_default as id from fx_instance) k left join fx_worker w on w.id = k.id
union all select 'dumpjob_status', cast(k.id as string), d.status
  from (select distinct dumpjob_id as id from fx_catalog) k left join fx_dumpjob d on d.id = k.id
union all select 'restorejob_status', cast(k.id as string), r.status
  from (select distinct restorejob_id as id from fx_restorelog) k left join fx_restorejob r on r.id = k.id
union all select 'catalog_exists', cast(k.id as string), case when c.id is null then '0' else '1' end
  from (select distinct catalog_id as id from fx_restorejob where catalog_id is not null) k left join fx_catalog c on c.id = k.id""")
def _lookups(m):
    def ids(df, c):
        return df.select(F.col(c).alias("id"))

    inst = m.instance
    parts = [
        j.lookup(inst, ids(m.dumpjob, "pgsql_instance_id"), ["id"], s.host_port("dns_name", "pgport"), "instance_name"),
        j.lookup(inst, ids(m.restorejob, "dest_pgsql_instance_id"), ["id"], F.col("worker_id_default"), "default_worker"),
        j.lookup(inst, ids(m.discovered, "pgsql_instance_id"), ["id"], F.col("def_jobstatus"), "def_jobstatus"),
        j.lookup(inst, inst, ["dns_name", "pgport"], F.col("id"), "instance_id"),
        j.lookup(m.worker, m.worker, ["dns_name"], F.col("id"), "worker_id"),
        j.lookup(m.worker, ids(inst, "worker_id_default"), ["id"], F.col("cron_clean"), "cron_clean"),
        j.lookup(m.dumpjob, ids(m.catalog, "dumpjob_id"), ["id"], F.col("status"), "dumpjob_status"),
        j.lookup(m.restorejob, ids(m.restorelog, "restorejob_id"), ["id"], F.col("status"), "restorejob_status"),
        j.key_exists(m.catalog, m.restorejob, "catalog_id", "catalog_exists"),
    ]
    return reduce(DataFrame.unionByName, parts)


ROUTED = """select r.id as restore_id, r.catalog_id, r.cron, c.bu_name, c.starttime, r.dest_dbname, r.restoreschema, r.restoretype,
  r.restoreoptions, coalesce(w.restore_worker_id, c.bu_worker_id) as route_worker_id
from fx_restorejob r join fx_catalog c on r.catalog_id = c.id join fx_worker w on w.id = c.bu_worker_id"""
NOW_WHERE = "where r.status = 'ACTIVE' and r.jobtype = 'SINGLE' and r.cron = '* * * * *'"


@query("restore_routing", f"{ROUTED} where r.cron <> '* * * * *'")
def _routing(m):
    return j.restore_routing(m.restorejob, m.catalog, m.worker)


def _routing_now(m):
    return j.restore_routing(m.restorejob, m.catalog, m.worker, run_now=True)


@query("pending_counts", f"""select worker_id, 'DUMP' as jobclass, count(*) as pending from ({JWI})
  where cron = '* * * * *' and jobtype = 'SINGLE' and status = 'ACTIVE' group by worker_id
union all select route_worker_id, 'RESTORE', count(*) from ({ROUTED} {NOW_WHERE}) group by route_worker_id""")
def _pending(m):
    return j.pending_counts(
        j.run_now_jobs(v.dumpjob_worker_instance_view(m.dumpjob, m.worker, m.instance)), _routing_now(m))


@query("capped_start", f"""select restore_id, catalog_id, route_worker_id from (
  select t.*, row_number() over (partition by route_worker_id order by restore_id) as rn, coalesce(g.r_regionkey % 3, 0) as n
  from ({ROUTED} {NOW_WHERE}) t left join region g on g.r_regionkey = t.route_worker_id) where rn <= greatest(2 - n, 0)""")
def _capped(m):
    running = m.region.selectExpr("r_regionkey as worker_id", "r_regionkey % 3 as n")
    return j.capped_start(_routing_now(m), running)


@query("discover_databases", f"""select d.pgsql_instance_id, d.datname as dbname, 'auto added dump job' as comment,
  case when i.def_jobstatus = 'INHERIT' then 'ACTIVE' else i.def_jobstatus end as status, {RND} as cron, i.worker_id_default as worker_id
from fx_discovered d join fx_instance i on i.id = d.pgsql_instance_id
where not d.datistemplate and d.datallowconn and i.status = 'ACTIVE'
  and not exists (select 1 from fx_dumpjob j where j.pgsql_instance_id = d.pgsql_instance_id and j.dbname = d.datname)""")
def _discover(m):
    return j.discover_databases(m.discovered, m.dumpjob, m.instance)


@query("effective_status", """select id, coalesce(live, cached, 'ACTIVE') as status,
  coalesce(live, cached, 'ACTIVE') <> coalesce(cached, 'ACTIVE') as changed
from (select id, case when id % 5 = 0 then null else status end as live,
  case when id % 7 = 0 then null when id % 3 = 0 then 'HALTED' else 'ACTIVE' end as cached from fx_instance)""")
def _effective(m):
    live = m.instance.selectExpr("id", "case when id % 5 = 0 then null else status end as status")
    cached = m.instance.selectExpr("id", "case when id % 7 = 0 then null when id % 3 = 0 then 'HALTED' else 'ACTIVE' end as status")
    return j.effective_status(cached, live)


LATEST = """select pgsql_dns_name, pgsql_port, id as cat_id, bu_worker_id as worker_id, dbname, starttime as st from (
  select *, row_number() over (partition by pgsql_dns_name, pgsql_port, dbname order by starttime desc, id desc) as rn from fx_catalog
  where status = 'SUCCESS' and keep in ('AUTO', 'YES') and dumptype = 'FULL' and dumpschema = '*' and dbname not like 'db_1') where rn = 1"""


@query("latest_dump_per_db", LATEST)
def latest(m):
    return j.latest_dump_per_db(m.catalog, "db_1")


@query("latest_dump_join", f"select * from fx_catalog where id in (select cat_id from ({LATEST}))")
def _latest_join(m):
    return j.latest_dump_join(latest(m), m.catalog)


@query("status_changes", """select job_id, "at", event_id, old_status, status from (
  select *, lag(status) over (partition by job_id order by "at", event_id) as old_status from fx_status) where status <> old_status""")
def changes(m):
    return j.status_changes(m.status)


@query("status_messages", """select 'INFO' as level, 'catalog_db' as tool, t."at" as logtime,
  'dump job: ' || p.dns_name || ':' || p.pgport || '/' || d.dbname || '.' || d.dumpschema || ' - job id: ' || t.job_id || ' - status: ' || t.status as message,
  'CACHE_CONFIG' as jobclass, t.job_id as jobid, '-1' as bu_worker_id
from (select *, lag(status) over (partition by job_id order by "at", event_id) as old_status from fx_status) t
  join fx_dumpjob d on d.id = t.job_id left join fx_instance p on p.id = d.pgsql_instance_id where t.status <> t.old_status""")
def _change_messages(m):
    return j.status_messages(changes(m), m.dumpjob, m.instance)


RUNNING = """select worker_id, process_id, "at" as starttime, seq from (
  select *, row_number() over (partition by worker_id, process_id order by "at" desc, seq desc) as rn from fx_activity) where rn = 1 and op = 'START'"""


@query("running_activity", RUNNING)
def _running(m):
    return j.running_activity(m.activity)


@query("dump_eligibility", """select j.id, case when w.status = 'HALTED' then 'QUIT' when p.status = 'HALTED' then 'ABANDON'
  when j.jobtype = 'SINGLE' and j.status = 'HALTED' then 'ALREADY_RUN' when f.val = 'NO' then 'ON_DEMAND_SKIP' else 'RUN' end as decision
from fx_dumpjob j join fx_worker w on w.id = j.worker_id join fx_instance p on p.id = j.pgsql_instance_id
  left join (select 'db' || n_nationkey as dbname, case n_regionkey when 0 then 'NO' when 1 then 'YES' else 'SCHEDULE' end as val from nation) f on f.dbname = j.dbname""")
def _dump_eligibility(m):
    flags = m.nation.selectExpr("'db' || n_nationkey as dbname", "case n_regionkey when 0 then 'NO' when 1 then 'YES' else 'SCHEDULE' end as val")
    return j.dump_eligibility(m.dumpjob, m.worker, m.instance, flags, start_type="CRON", on_demand=True)


@query("restore_eligibility", """select r.id, case when start = 'SINGLE!' then 'ERROR' when r.existing_db = 'LEAVE' and d.datname is not null then 'ABORTED'
    when p.status = 'HALTED' or start = 'CRON' and r.status <> 'ACTIVE' or coalesce(c.status, 'FAILED') <> 'SUCCESS' then 'ERROR' else 'RUN' end as decision,
  case when start = 'SINGLE!' then 'wrong start type' when r.existing_db = 'LEAVE' and d.datname is not null then 'database is already present'
    when p.status = 'HALTED' then 'instance is inactive' when start = 'CRON' and r.status <> 'ACTIVE' then 'job is on halt'
    when coalesce(c.status, 'FAILED') <> 'SUCCESS' then 'dump does not exist or failed' else '' end as reason
from (select *, case when restoreoptions <> '' then 'SINGLE!' when jobtype = 'REPEAT' then 'CRON' else jobtype end as start from fx_restorejob) r
  join fx_instance p on p.id = r.dest_pgsql_instance_id left join fx_catalog c on c.id = r.catalog_id
  left join fx_discovered d on d.pgsql_instance_id = r.dest_pgsql_instance_id and d.datname = r.dest_dbname""")
def _restore_eligibility(m):
    start = F.expr("case when restoreoptions <> '' then 'SINGLE!' when jobtype = 'REPEAT' then 'CRON' else jobtype end")
    return j.restore_eligibility(m.restorejob, m.instance, m.catalog, m.discovered, start)


@query("restore_plan", """with t as (select dump_id, max(case when contains(line, 'DATABASE') then 1 else 0 end) as db from fx_toc group by dump_id),
x as (select r.*, ends_with(c.bu_name, '.sql.gz') as is_sql, coalesce(t.db, 0) = 0 or r.restoreschema <> '*' or r.restoretype = 'DATA' as direct
  from fx_restorejob r join fx_catalog c on c.id = r.catalog_id left join t on t.dump_id = r.catalog_id)
select id, case when is_sql then 'SQL' else 'DIR' end as mode, case when not is_sql then case when direct then 'DIRECT' else 'STAGED' end end as target,
  concat_ws(' ', nullif(restoreoptions, ''), case when not is_sql and restoretype = 'DATA' then '--data-only' end,
    case when not is_sql and restoretype = 'SCHEMA' then '--schema-only' end, case when not is_sql and role_handling = 'NO_ROLE' then '--no-owner --no-privileges' end,
    case when not is_sql and tblspc_handling = 'NO_TBLSPC' then '--no-tablespaces' end) as options,
  case when is_sql or direct then 'NONE' when existing_db = 'DROP' then 'DROP_AND_MOVE' when existing_db = 'RENAME' then 'RENAME_AND_MOVE' else 'MOVE' end as final_action
from x""")
def _plan(m):
    return j.restore_plan(m.restorejob, m.catalog, extract.toc_flags(m.toc))


@query("server_restore", f"""select i.id as dest_pgsql_instance_id, l.dbname as dest_dbname, 'FULL' as restoretype, '*' as restoreschema, '' as restoreoptions,
  'LEAVE' as existing_db, 'generated server restore job' as comment, 'SINGLE' as jobtype, '* * * * *' as cron, l.cat_id as catalog_id,
  'USE_ROLE' as role_handling, 'USE_TBLSPC' as tblspc_handling
from ({LATEST}) l join fx_instance i on 's' || i.id = l.pgsql_dns_name and l.pgsql_port = 5432""")
def _server_restore(m):
    routes = m.instance.selectExpr("'s' || id as src_dns_name", "5432 as src_port", "id as dest_instance_id")
    return j.server_restore(latest(m), routes)


@query("copy_link", """select dest_pgsql_instance_id as id, string_agg(cast(id as string), ',' order by id) as restorejob_id, 'ACTIVE' as status
from fx_restorejob group by dest_pgsql_instance_id""")
def _copy_link(m):
    return j.copy_link(m.restorejob.select(F.col("dest_pgsql_instance_id").alias("dumpjob_id"), F.col("id").alias("restorejob_id")))


@query("restore_log_upsert", """select id, restorejob_id, starttime, case when endtime is null then 'RUNNING' else status end as status,
  case when endtime is null then bu_path when status = 'ERROR' then 'cat_id=' || id else bu_path end as bu_path, endtime,
  case when endtime is not null then message end as message, case when endtime is not null then bu_worker_id end as bu_worker_id,
  case when endtime is not null then pgsql_dns_name end as pgsql_dns_name, case when endtime is not null then pgsql_port end as pgsql_port,
  case when endtime is not null then dest_dbname end as dest_dbname, case when endtime is not null then restoreschema end as restoreschema,
  case when endtime is not null then restoretype end as restoretype, case when endtime is not null then src_dbname end as src_dbname
from fx_restorelog""")
def _upsert(m):
    log = m.restorelog
    starts = log.select("id", "restorejob_id", "starttime", "bu_path")
    done = log.filter(F.col("endtime").isNotNull()).withColumn(
        "bu_path", F.when(F.col("status") == "ERROR", F.col("id").cast("string")).otherwise(F.col("bu_path")))
    early = done.withColumn("status", F.lit("WAITING")).withColumn("seq", F.lit(1))
    ends = done.withColumn("seq", F.lit(2)).unionByName(early).select("id", "seq", *j.END_COLUMNS)
    return j.restore_log_upsert(starts, ends)
