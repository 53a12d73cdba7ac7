"""Registered queries: text extraction."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as s
from keepsake.operators import extract as x
from keepsake.plans.registry import query

ROLES = r"""select distinct dump_id, replace(regexp_extract(line, '(\S+).$', 1), '"', '') as role from fx_ddl
where regexp_matches(line, '^(ALTER\ .*PRIVILEGES\ FOR\ .*;|ALTER\ .*OWNER\ TO.*;|GRANT\ .*ON\ .*TO\ .*;|REVOKE\ .*ON\ .*FROM\ .*;)$')
  and not regexp_extract(line, '(\S+).$', 1) ilike '%public%'"""
SPACES = r"""select distinct dump_id, replace(split_part(line, ' ', 4), ';', '') as tablespace from fx_ddl
where regexp_matches(line, '^SET default_tablespace = .*[^''];')"""
ACL = """select datname, entry_no, split_part(acl, '=', 1) as acl_role, split_part(split_part(acl, '=', 2), '/', 1) as acl_rights
from (select datname, unnest(string_split(datacl, ',')) as acl, unnest(range(1, len(string_split(datacl, ',')) + 1))::int as entry_no from fx_acl)"""
LOG_LINE = "strftime(logtime, '%Y%m%dT%H%M%S') || '+0000 ' || level || ' ' || tool || '  ' || message"


def log_lines(message):
    return message.select("id", F.concat(
        s.compact_stamp("logtime"), F.lit(" "), "level", F.lit(" "), "tool", F.lit("  "), "message").alias("line"))


@query("ddl_roles", ROLES)
def _roles(m):
    return x.ddl_roles(m.ddl)


@query("ddl_tablespaces", SPACES)
def _spaces(m):
    return x.ddl_tablespaces(m.ddl)


@query("ddl_role_statements", """select line_no, dump_id, line, replace(split_part(line, ' ', 3), ';', '') as role from fx_ddl where line like 'CREATE ROLE %'""")
def _role_lines(m):
    return x.ddl_role_statements(m.ddl)


@query("toc_schema_entries", r"""select line_no, dump_id, line, regexp_extract(line, '(?:COMMENT - SCHEMA|SCHEMA -|ACL -) (\S+) ', 1) as schema_name from fx_toc
where regexp_matches(line, '(COMMENT - SCHEMA|SCHEMA -|ACL -) (\S+) ')""")
def _schema_entries(m):
    return x.toc_schema_entries(m.toc)


@query("toc_flags", """select dump_id, bool_or(contains(line, 'DATABASE')) as has_database, bool_or(contains(line, 'SCHEMA')) as has_schema from fx_toc group by dump_id""")
def _flags(m):
    return x.toc_flags(m.toc)


@query("toc_truncate", """select dump_id, line_no, 'TRUNCATE TABLE ' || split_part(line, ' ', 6) || '.' || split_part(line, ' ', 7) || ';' as statement
from fx_toc where contains(line, 'TABLE DATA')""")
def _truncate(m):
    return x.toc_truncate(m.toc)


@query("acl_explode", ACL)
def _acl(m):
    return x.acl_explode(m.acl)


@query("acl_grants", f"""with e as (select datname, entry_no, case when acl_role = '' then 'public' else acl_role end as who, acl_rights from ({ACL})),
g as (select distinct datname, 0 as entry_no, 0 as k, 'REVOKE ALL ON DATABASE ' || datname || ' FROM public;' as statement from fx_acl
union all select datname, entry_no, 1, 'REVOKE ALL ON DATABASE ' || datname || ' FROM ' || who || ';' from e
union all select datname, entry_no, 2, 'GRANT CREATE ON DATABASE ' || datname || ' TO ' || who || ';' from e where contains(acl_rights, 'C')
union all select datname, entry_no, 3, 'GRANT TEMP ON DATABASE ' || datname || ' TO ' || who || ';' from e where contains(acl_rights, 'T')
union all select datname, entry_no, 4, 'GRANT CONNECT ON DATABASE ' || datname || ' TO ' || who || ';' from e where contains(acl_rights, 'c'))
select datname, cast(row_number() over (partition by datname order by entry_no, k) as int) as statement_no, statement from g""")
def _grants(m):
    return x.acl_grants(m.acl)


@query("acl_roles", f"select distinct acl_role as role from ({ACL}) where acl_role <> ''")
def _acl_roles(m):
    return x.acl_roles(m.acl)


@query("missing_tablespaces", f"select dump_id, tablespace from ({SPACES}) where tablespace not in (select 'ts' || r_regionkey * 2 from region)")
def _missing_spaces(m):
    return x.missing_tablespaces(m.ddl, m.region.selectExpr("'ts' || r_regionkey * 2 as tablespace"))


NEEDED = f"""(select dump_id, role from ({ROLES}) union
  select c.id, r.role from fx_catalog c join (select datname, acl_role as role from ({ACL}) where acl_role <> ''
    union select 'db' || n_nationkey, 'owner' || n_nationkey from nation) r on r.datname = c.dbname)"""


def needed(m):
    owners = m.nation.selectExpr("'db' || n_nationkey as datname", "'owner' || n_nationkey as role")
    return m.ddl, m.acl, owners, m.catalog.select(F.col("id").alias("dump_id"), "dbname")


@query("missing_roles", f"select dump_id, role from {NEEDED} where role not in (select 'role' || n_nationkey * 2 from nation)")
def _missing_roles(m):
    return x.missing_roles(*needed(m), m.nation.selectExpr("'role' || n_nationkey * 2 as role"))


@query("restore_preparation", f"""with there as (
  select i.id as instance, 'role' as kind, 'role' || n_nationkey as name from fx_instance i join nation on n_nationkey % 4 <> i.id % 4
  union all select i.id, 'tablespace', 'ts' || r_regionkey from fx_instance i join region on r_regionkey % 2 = i.id % 2),
want as (select dump_id, 'role' as kind, role as name from {NEEDED} union all select dump_id, 'tablespace', tablespace from ({SPACES}))
select j.id as restore_id, w.kind, w.name from fx_restorejob j join want w on w.dump_id = j.catalog_id
where case when w.kind = 'role' then j.role_handling = 'USE_ROLE' else j.tblspc_handling = 'USE_TBLSPC' end
  and not exists (select 1 from there t where t.instance = j.dest_pgsql_instance_id and t.kind = w.kind and t.name = w.name)""")
def _preparation(m):
    i = m.instance.select(F.col("id").alias("pgsql_instance_id"))
    there = i.join(m.nation, F.expr("n_nationkey % 4 <> pgsql_instance_id % 4")).selectExpr("pgsql_instance_id", "'role' as kind", "'role' || n_nationkey as name").union(
        i.join(m.region, F.expr("r_regionkey % 2 = pgsql_instance_id % 2")).selectExpr("pgsql_instance_id", "'tablespace'", "'ts' || r_regionkey"))
    return x.restore_preparation(m.restorejob, x.needed_roles(*needed(m)), x.ddl_tablespaces(m.ddl), there)


@query("pipe_lookup", """select cast(d.id as string) as key, d.dbname as value from fx_dumpjob d where d.id in (select id from fx_restorejob)""")
def _pipe(m):
    lines = m.dumpjob.selectExpr("concat_ws('|', id, worker_id, pgsql_instance_id, dbname, cron) as line")
    return x.pipe_lookup(lines, m.restorejob.selectExpr("cast(id as string) as key"), 4)


@query("log_parse", "select date_trunc('second', logtime) as logtime, level, tool, message from fx_message")
def _log(m):
    return x.log_parse(log_lines(m.message))


@query("log_to_message", f"""select date_trunc('second', logtime) as logtime, level, tool, message, 'CACHE_CONFIG' as jobclass, -1 as jobid, '3' as bu_worker_id
from fx_message where regexp_matches({LOG_LINE}, 'WARNING|ERROR')""")
def _log_message(m):
    return x.log_to_message(log_lines(m.message), worker=3)


@query("settings_row", """select a.datname, 'owner' || a.db_id % 3 as owner, 'UTF8' as encoding,
  case when a.db_id % 2 = 0 then 'C' else 'en_US.UTF-8' end as collate, case when a.db_id % 5 = 0 then 'C' else 'en_US.UTF-8' end as ctype,
  a.datacl as acl_rights, case when r.r_regionkey <> 0 then lower(r.r_name) end as dattablespace
from fx_acl a left join region r on r.r_regionkey = a.db_id % 5""")
def _settings(m):
    databases = m.acl.selectExpr(
        "datname", "'owner' || db_id % 3 as owner", "'UTF8' as encoding",
        "case when db_id % 2 = 0 then 'C.UTF-8' else 'en_US.UTF-8' end as datcollate",
        "case when db_id % 5 = 0 then 'C.utf8' else 'en_US.UTF-8' end as datctype", "datacl", "db_id % 5 as tablespace_id")
    spaces = m.region.selectExpr("r_regionkey as id", "case when r_regionkey = 0 then 'pg_default' else lower(r_name) end as spcname")
    return x.settings_row(databases, spaces)
