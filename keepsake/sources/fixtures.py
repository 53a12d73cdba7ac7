"""Catalog tables derived from the driver's parquet tables (``FIXTURES.md`` §B).

Each entry is one query that Spark and DuckDB both accept; ``{orders}`` and the
like stand for the driver table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.session import settle

FIXTURES: dict[str, str] = {
    "fx_worker": """
select cast(r_regionkey as int) as id, lower(r_name) as dns_name,
  case when r_regionkey = 2 then 'every day' else '15 20 * * *' end as cron_cacheconfig,
  '* * * * *' as cron_singlejob, '15 18 * * *' as cron_clean, '*/5 * * * *' as cron_upload,
  case when r_regionkey = 4 then 'HALTED' else 'ACTIVE' end as status,
  case when r_regionkey = 3 then 0 end as restore_worker_id,
  'worker ' || r_name as comment,
  timestamp '2000-01-01 00:00:00' as date_added
from {region}""",
    "fx_instance": """
select cast(s_suppkey as int) as id,
  case when s_suppkey % 10 = 0 then 'local' when s_suppkey % 10 = 1 then lower(s_name) || '.' else lower(s_name) end as dns_name,
  cast(5432 + s_suppkey % 3 as int) as pgport, 'postgres' as pgsql_superuser,
  case when s_suppkey % 11 = 7 then 'HALTED' else 'ACTIVE' end as status,
  cast(s_nationkey % 24 as int) as bu_window_start, cast((s_suppkey * 7) % 24 as int) as bu_window_end,
  case when s_suppkey % 9 = 4 then 99 else cast(s_nationkey % 5 as int) end as worker_id_default,
  case s_suppkey % 3 when 0 then 'INHERIT' when 1 then 'HALTED' else 'ACTIVE' end as def_jobstatus,
  s_name as comment,
  timestamp '2000-01-01 00:00:00' + (s_suppkey % 1000) * interval '1' second as date_added
from {supplier}""",
    "fx_dumpjob": """
select cast(c_custkey as int) as id, cast(c_custkey % 5 as int) as worker_id,
  cast(c_custkey % 10 as int) as pgsql_instance_id,
  'db' || cast(c_custkey % 40 as string) as dbname,
  case c_mktsegment when 'MACHINERY' then 'SCHEMA' when 'FURNITURE' then 'CLUSTER_SCHEMA'
    when 'BUILDING' then 'SCRIPT' when 'AUTOMOBILE' then 'CLUSTER' else 'FULL' end as dumptype,
  case when c_custkey % 4 = 0 then 'Sales' else '*' end as dumpschema,
  case when c_custkey % 3 = 0 then '--verbose' end as dumpoptions,
  case when c_custkey % 6 = 0 then null else cast(c_custkey % 15 as int) end as keep_daily,
  case when c_custkey % 6 = 0 then null else cast(c_custkey % 4 as int) end as keep_weekly,
  cast(c_custkey % 7 as int) as keep_monthly, cast(c_custkey % 3 as int) as keep_yearly,
  c_name as comment,
  case when c_custkey % 5 = 0 then '* * * * *' when c_custkey % 23 = 1 then '@daily'
    else cast(c_custkey % 60 as string) || ' ' || cast(c_custkey % 24 as string) || ' * * *' end as cron,
  case when c_acctbal < 500 then 'HALTED' else 'ACTIVE' end as status,
  case when c_custkey % 7 < 3 then 'SINGLE' else 'REPEAT' end as jobtype,
  case when c_custkey % 8 = 0 then cast(c_custkey % 20 as string) || ',' || cast(c_custkey % 20 + 1 as string)
    when c_custkey % 8 = 1 then '' end as restorejob_id,
  timestamp '2000-01-01 00:00:00' + (c_custkey % 5) * interval '1' day as date_added
from {customer}""",
    "fx_catalog": """
select cast(o_orderkey as int) as id, cast(case when o_custkey % 10 = 9 then 2000000000 + o_custkey % 50 else o_custkey % 50 end as int) as dumpjob_id,
  o_orderdate + (o_orderkey % 86400) * interval '1' second as starttime,
  o_orderdate + (o_orderkey % 86400 + o_orderkey % 3600 + 1) * interval '1' second as endtime,
  case when o_orderkey % 97 = 0 then 'REMOVING' when o_orderstatus = 'P' then 'FAILED' else 'SUCCESS' end as status,
  'dump_' || cast(o_orderkey as string) || case when o_orderpriority = '2-HIGH' then '.sql.gz' else '' end as bu_name,
  case when o_orderkey % 89 = 0 then '/data/snapshots/../x/' when o_orderkey % 83 = 0 then '/tmp/' else '/data/snapshots/' end || cast(o_custkey % 50 as string) as bu_location,
  cast(floor(o_totalprice) as bigint) as dbsize, cast(floor(o_totalprice / 3) as bigint) as dumpsize,
  'db' || cast((o_custkey % 50) % 40 as string) as dbname,
  case when o_custkey % 4 = 0 then 'Sales' else '*' end as dumpschema,
  case o_orderpriority when '1-URGENT' then 'SCHEMA' when '2-HIGH' then 'CLUSTER' when '5-LOW' then 'SCRIPT' else 'FULL' end as dumptype,
  case when o_orderkey % 3 = 0 then 'YES' when o_orderkey % 31 = 0 then 'FAILED' else 'NO' end as verified,
  case when o_orderkey % 101 = 0 then 'YES' when o_orderkey % 53 = 0 then 'NO' else 'AUTO' end as keep,
  case when o_orderpriority = '2-HIGH' then '.sql.gz' else '' end as bu_extension,
  '93' as pgversion, cast(o_custkey % 5 as int) as bu_worker_id,
  case when o_orderkey % 17 = 0 then null else 'auto added dump job for order ' || cast(o_orderkey as string) end as message,
  's' || cast(o_custkey % 10 as string) as pgsql_dns_name, cast(5432 as int) as pgsql_port
from {orders}""",
    "fx_restorejob": """
select cast(p_partkey as int) as id, cast(p_partkey % 10 as int) as dest_pgsql_instance_id,
  'db' || cast(p_partkey % 45 as string) as dest_dbname,
  case p_size % 3 when 0 then 'FULL' when 1 then 'DATA' else 'SCHEMA' end as restoretype,
  case p_partkey % 4 when 0 then 'Sales' when 1 then 'sales_1' else '*' end as restoreschema,
  case when p_partkey % 9 = 0 then '--jobs=2' else '' end as restoreoptions,
  case p_partkey % 5 when 0 then 'DROP' when 1 then 'RENAME' when 2 then 'DROP_BEFORE' when 3 then 'LEAVE' else 'TRUNCATE' end as existing_db,
  case when p_size % 4 = 0 then 'HALTED' else 'ACTIVE' end as status,
  p_name as comment,
  case p_partkey % 3 when 0 then 'SINGLE' when 1 then 'REPEAT' else 'TRIGGER' end as jobtype,
  case when p_partkey % 3 = 1 then '30 4 * * *' else '* * * * *' end as cron,
  case when p_partkey % 3 = 2 then null else cast((p_partkey * 3) % 1500 as int) end as catalog_id,
  case when p_partkey % 2 = 0 then 'USE_ROLE' else 'NO_ROLE' end as role_handling,
  case when p_partkey % 6 = 0 then 'USE_TBLSPC' else 'NO_TBLSPC' end as tblspc_handling,
  timestamp '2000-01-01 00:00:00' + (p_partkey % 30) * interval '1' day as date_added
from {part}""",
    "fx_restorelog": """
select cast(o_orderkey as int) as id, case when o_orderkey % 211 = 5 then 999999 else cast(o_orderkey % 200 as int) end as restorejob_id,
  o_orderdate + (o_orderkey % 7200) * interval '1' second as starttime,
  case when o_orderkey % 13 <> 0 then o_orderdate + (o_orderkey % 7200 + o_orderkey % 600) * interval '1' second end as endtime,
  case when o_orderkey % 13 = 0 then 'RUNNING' when o_orderkey % 7 = 0 then 'ERROR' else 'COMPLETED' end as status,
  '/data/snapshots/' || cast(o_custkey % 50 as string) || '/dump_' || cast(o_orderkey - o_orderkey % 2 as string) as bu_path,
  'restored dump of order ' || cast(o_orderkey as string) as message,
  case when o_orderkey % 19 = 0 then null else cast(o_custkey % 5 as int) end as bu_worker_id,
  's' || cast(o_custkey % 10 as string) as pgsql_dns_name, cast(5432 as int) as pgsql_port,
  'db' || cast(o_custkey % 45 as string) as dest_dbname, '*' as restoreschema, 'FULL' as restoretype,
  'db' || cast(o_custkey % 40 as string) as src_dbname
from {orders}""",
    "fx_message": """
select cast(event_id as int) as id,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' when 'signup' then 'CRITICAL' when 'view' then 'DEBUG' else 'INFO' end as level,
  'tool_' || event_type as tool, ts as logtime, event_type || ' ' || props as message,
  case cast(user_id % 6 as int) when 0 then 'CACHE_CONFIG' when 1 then 'DUMP' when 2 then 'RESTORE' when 3 then 'VERIFY' when 4 then 'DEDUP' else 'CLEAN' end as jobclass,
  cast(user_id as int) as jobid, cast(event_id % 5 as string) as bu_worker_id
from {events}""",
    "fx_activity": """
select event_id as seq, ts as at, cast(user_id % 5 as int) as worker_id, cast(user_id as int) as process_id,
  case when event_type in ('signup', 'click') then 'START' else 'END' end as op
from {events}""",
    "fx_status": """
select cast(user_id as int) as job_id, ts as at, event_id, event_type as status
from {events}""",
    "fx_discovered": """
select distinct cast(c_custkey % 10 as int) as pgsql_instance_id, 'db' || cast(c_custkey % 70 as string) as datname,
  c_custkey % 70 = 69 as datistemplate, c_custkey % 70 <> 68 as datallowconn
from {customer}""",
    "fx_file": """
select cast(doc_id as int) as file_id, cast(substr(source, 4) as int) as dump_id,
  'dump_' || substr(source, 4) || '/' || cast(doc_id as string) || '.dat.gz' as path,
  md5(text) as checksum, n_chars as size
from {documents}""",
    "fx_store": """
select md5(case when doc_id % 2 = 0 then text else 'older ' || text end) as checksum, max(n_chars) as size from {documents}
group by md5(case when doc_id % 2 = 0 then text else 'older ' || text end)
union all
select md5('orphan ' || cast(r_regionkey as string)) as checksum, cast(100 as bigint) as size from {region}""",
    "fx_ddl": """
select cast(doc_id as int) as line_no, cast(substr(source, 4) as int) as dump_id,
  case cast(doc_id % 7 as int)
    when 0 then 'GRANT ALL ON SCHEMA s1 TO role' || cast(doc_id % 17 as string) || ';'
    when 1 then 'REVOKE ALL ON SCHEMA s1 FROM "Role' || cast(doc_id % 5 as string) || '";'
    when 2 then 'ALTER TABLE s1.t OWNER TO owner' || cast(doc_id % 11 as string) || ';'
    when 3 then 'GRANT ALL ON SCHEMA public TO PUBLIC;'
    when 4 then 'SET default_tablespace = ts' || cast(doc_id % 4 as string) || ';'
    when 5 then 'SET default_tablespace = '''';'
    else 'CREATE ROLE role' || cast(doc_id % 17 as string) || ';' end as line
from {documents}""",
    "fx_toc": """
select cast(doc_id as int) as line_no, cast(substr(source, 4) as int) as dump_id,
  cast(doc_id as string) || '; 0 ' || cast(doc_id * 7 as string) || ' ' ||
  case cast(doc_id % 6 as int)
    when 0 then 'SCHEMA - s' || cast(doc_id % 5 as string) || ' owner1'
    when 1 then 'COMMENT - SCHEMA s' || cast(doc_id % 5 as string) || ' owner1'
    when 2 then 'ACL - s' || cast(doc_id % 5 as string) || ' owner1'
    when 3 then 'DATABASE - db1 owner1'
    else 'TABLE DATA s' || cast(doc_id % 5 as string) || ' t' || cast(doc_id as string) || ' owner1' end as line
from {documents}""",
    "fx_acl": """
select cast(c_custkey as int) as db_id, 'db' || cast(c_custkey as string) as datname,
  '=T/postgres,role' || cast(c_custkey % 7 as string) || '=' ||
  case cast(c_custkey % 4 as int) when 0 then 'CTc' when 1 then 'c' when 2 then 'Tc' else 'C' end || '/postgres' as datacl
from {customer}""",
    "fx_relation": """
select 's_' || l_returnflag as table_schema, 't' || cast(l_partkey as string) as table_name,
  cast(floor(l_extendedprice) as bigint) as total_bytes, cast(l_quantity as bigint) as index_bytes,
  case when l_linenumber % 2 = 0 then null else cast(l_linenumber as bigint) end as toast_bytes,
  case when l_linenumber = 7 then 'v' else 'r' end as relkind
from {lineitem}""",
    "fx_upload": """
select event_id as line_no,
  '202401' || lpad(cast(event_id % 28 + 1 as string), 2, '0') || 'T' || lpad(cast(event_id % 24 as string), 2, '0') || '0000+0000' || chr(9) ||
  case when event_id % 13 = 0 then 'NOTICE' when event_type = 'error' then 'ERROR' else 'INFO' end || chr(9) ||
  'tool_' || event_type || chr(9) || props || chr(9) ||
  case when event_id % 29 = 0 then 'OTHER' else 'DUMP' end || chr(9) ||
  cast(user_id - 1 as string) || chr(9) || cast(event_id % 5 as string) as line
from {events}""",
}

# Column types of the driver tables that are read, so that no scan infers a schema.
DRIVER_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Model:
    """The catalog tables over one driver folder: ``model.catalog`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_SCHEMAS:
            return driver_table(self.spark, self.folder, name)
        text = FIXTURES.get("fx_" + name)
        if text is None:
            raise AttributeError(name)
        used = {t: driver_table(self.spark, self.folder, t) for t in DRIVER_SCHEMAS if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def written(self, name: str) -> DataFrame:
        """The table written down once, where its making is dear (checksums of whole texts)."""
        return settle(getattr(self, name), name)


def duckdb_text(name: str) -> str:
    """The same fixture query on the plain driver table names."""
    text = FIXTURES[name]
    for table in DRIVER_SCHEMAS:
        text = text.replace("{" + table + "}", table)
    return text
