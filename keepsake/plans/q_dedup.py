"""Registered queries: deduplication, sizes and list differences."""

from pyspark.sql import functions as F

from keepsake.operators import dedup, sizes
from keepsake.plans.registry import query

FIRSTS = "select checksum, min(file_id) as first_id from fx_file group by checksum"
CLASSIFY = """select f.file_id, f.dump_id, f.path, f.checksum, f.size,
  case when f.checksum not in (select checksum from fx_store) and row_number() over (partition by f.checksum order by f.file_id) = 1
    then 'STORE' else 'LINK' end as action,
  substr(f.checksum, 1, 1) || '/' || substr(f.checksum, 2, 1) || '/' || f.checksum as blob from fx_file f"""


@query("first_occurrence", """select file_id, dump_id, path, checksum, size,
  row_number() over (partition by checksum order by file_id) = 1 as is_first from fx_file""")
def _first(m):
    return dedup.first_occurrence(m.written("file"))


@query("dedup_classify", CLASSIFY)
def _classify(m):
    return dedup.dedup_classify(m.written("file"), m.store)


@query("dedup_store_update", """select checksum, size from fx_store union all
select checksum, min(size) as size from fx_file where checksum not in (select checksum from fx_store) group by checksum""")
def _store_update(m):
    return dedup.store_update(m.written("file"), m.store)


@query("dedup_once", """select file_id, dump_id, path, checksum, size from fx_file
where dump_id in (select id from fx_catalog where dumptype = 'FULL') and dump_id not in (select r_regionkey from region)""")
def _once(m):
    return dedup.dedup_once(m.file, m.catalog, m.region.select(F.col("r_regionkey").alias("dump_id")))


@query("dedup_read", """select f.file_id, f.dump_id, f.path, f.checksum, f.size, s.size as blob_size
from fx_file f join fx_store s on s.checksum = f.checksum""")
def _read(m):
    return dedup.dedup_read(m.file, m.store)


@query("dedup_summary", f"""with c as ({CLASSIFY}), s as (
  select dump_id, cast(500 + sum(size) as bigint) as total_bytes, cast(500 + sum(case when action = 'STORE' then size else 0 end) as bigint) as stored_bytes,
    count(*) filter (action = 'LINK') as existing_files from c group by dump_id)
select *, cast(cast(round_even(cast(stored_bytes as double) / cast(total_bytes as double) * 100, 0) as bigint) as string) as remaining_percent from s""")
def _summary(m):
    return dedup.dedup_summary(_classify(m), base_size=500)


@query("link_counts", """select s.checksum, s.size, count(f.file_id) as links from fx_store s left join fx_file f on f.checksum = s.checksum
group by s.checksum, s.size""")
def _links(m):
    return dedup.link_counts(m.file, m.store)


@query("orphan_blobs", """select checksum, size from fx_store where checksum not in (select checksum from fx_file)
  and exists (select 1 from fx_store s join fx_file f on f.checksum = s.checksum)""")
def _orphans(m):
    return dedup.orphan_blobs(m.file, m.store)


@query("orphan_after_remove", """with gone as (select id from fx_catalog where status <> 'SUCCESS')
select checksum, count(*) as removed_links from fx_file group by checksum
having count(*) = count(*) filter (dump_id in (select id from gone))""")
def _after_remove(m):
    return dedup.orphan_after_remove(m.file, m.catalog.filter("status <> 'SUCCESS'").select(F.col("id").alias("dump_id")))


@query("size_total", "select cast(coalesce(sum(total_bytes), -1) as bigint) as total_bytes from fx_relation where relkind = 'r'")
def _size(m):
    return sizes.size_total(m.relation)


@query("size_by_schema", """select table_schema, cast(sum(total_bytes) as bigint) as total_bytes,
  cast(sum(total_bytes - index_bytes - coalesce(toast_bytes, 0)) as bigint) as table_bytes from fx_relation where relkind = 'r' group by table_schema""")
def _by_schema(m):
    return sizes.size_by_schema(m.relation)


@query("config_diff", """with a as (select cast(id as string) || '|' || dbname || '|' || cron as line from fx_dumpjob),
b as (select cast(id as string) || '|' || dbname || '|' || case when status = 'HALTED' then '0 0 * * *' else cron end as line from fx_dumpjob)
select 'removed' as change, line from (select line from a except all select line from b)
union all select 'added', line from (select line from b except all select line from a)""")
def _diff(m):
    before = m.dumpjob.selectExpr("cast(id as string) || '|' || dbname || '|' || cron as line")
    after = m.dumpjob.selectExpr("cast(id as string) || '|' || dbname || '|' || case when status = 'HALTED' then '0 0 * * *' else cron end as line")
    return sizes.config_diff(before, after)
