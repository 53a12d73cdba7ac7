"""Registered queries: retention and verification."""

from pyspark.sql import functions as F

from keepsake.operators import retention as r, verify as vf
from keepsake.plans import clean
from keepsake.plans.registry import NOW, query

ROOT = "/data/snapshots"

INFO = """select c.dumpjob_id, coalesce(j.keep_daily, 7) as keep_daily, coalesce(j.keep_weekly, 1) as keep_weekly,
  coalesce(j.keep_monthly, 0) as keep_monthly, coalesce(j.keep_yearly, 0) as keep_yearly
from (select distinct dumpjob_id from fx_catalog where dumpjob_id is not null) c left join fx_dumpjob j on j.id = c.dumpjob_id"""
SLICES = f"""info as ({INFO}),
steps as (
  select dumpjob_id, keep_daily d, keep_weekly w, keep_monthly m, keep_yearly y, 0 as slice_no,
    cast(null as string) as kind, cast(null as date) as slice_end, cast(timestamp '{NOW}' as date) + 1 as slice_start from info
  union all
  select dumpjob_id, d, w, m, y, slice_no + 1,
    case when slice_no < d then 'D' when slice_no < d + w then 'W' when slice_no < d + w + m then 'M' else 'Y' end,
    slice_start,
    cast(case when slice_no < d then slice_start - interval '1' day when slice_no < d + w then slice_start - interval '7' day
      when slice_no < d + w + m then slice_start - interval '1' month else slice_start - interval '1' year end as date)
  from steps where slice_no < d + w + m + y),
slices as (select dumpjob_id, kind, slice_no, slice_start, slice_end from steps where slice_no > 0)"""
PICKS = f"""{SLICES},
picks as (
  select s.dumpjob_id, s.kind, s.slice_no, s.slice_start, s.slice_end, c.id,
    row_number() over (partition by s.dumpjob_id, s.slice_no order by
      case when s.kind = 'D' then c.starttime end desc, case when s.kind <> 'D' then c.starttime end, c.id) as rn
  from slices s join fx_catalog c on c.dumpjob_id = s.dumpjob_id and c.starttime >= s.slice_start and c.starttime < s.slice_end
  where c.status = 'SUCCESS' and c.keep = 'AUTO')"""
PINNED = "select id from fx_catalog where keep = 'YES' or id in (select catalog_id from fx_restorejob where catalog_id is not null)"
KEEP = f"{PICKS}, keep_ids as (select id from picks where rn = 1 union {PINNED})"
GONE = f"""{KEEP}, gone as (select id, dumpjob_id, starttime, bu_name, bu_location || '/' || bu_name as full_path from fx_catalog
  where dumpjob_id is not null and id not in (select id from keep_ids))"""
SAFE = f"""{GONE}, safe as (select *, case when length(path) < 6 then 'path too short' when contains(path, '/../') then 'path contains /../'
  when not starts_with(path, '{ROOT}/') then 'path outside snapshot root' end as reason
  from (select *, regexp_replace(full_path, '.sql.gz$', '') as path from gone))"""
FREE = f"""{SAFE}, free as (select id, dumpjob_id, path from safe where reason is null
  and path not in (select regexp_replace(bu_path, '.sql.gz$', '') from fx_restorelog where status = 'RUNNING'))"""


@query("job_retention_info", INFO)
def _info(m):
    return r.job_retention_info(m.catalog, m.dumpjob)


@query("retention_slices", f"with recursive {SLICES} select * from slices")
def _slices(m):
    return r.retention_slices(_info(m), NOW)


@query("retention_keep", f"with recursive {PICKS} select dumpjob_id, kind, slice_no, slice_start, slice_end, id from picks where rn = 1")
def _keep(m):
    return r.retention_keep(m.catalog, m.dumpjob, NOW)


@query("slice_pick", f"with recursive {PICKS} select dumpjob_id, slice_no, id from picks where rn = 1")
def _pick(m):
    return r.slice_pick(m.catalog, _info(m), NOW).select("dumpjob_id", "slice_no", "id")


@query("retention_pinned", PINNED)
def _pinned(m):
    return r.retention_pinned(m.catalog, m.restorejob)


@query("keep_set", f"with recursive {KEEP} select id from keep_ids")
def _keep_set(m):
    return r.keep_set(m.catalog, m.dumpjob, m.restorejob, NOW)


@query("remove_set", f"with recursive {GONE} select id, dumpjob_id from gone")
def _remove_set(m):
    return r.remove_set(m.catalog, _keep_set(m)).select("id", "dumpjob_id")


@query("retention_remove", f"with recursive {GONE} select * from gone")
def retention_remove(m):
    return r.retention_remove(m.catalog, m.dumpjob, m.restorejob, NOW)


@query("remove_safe", f"with recursive {SAFE} select id, dumpjob_id, starttime, bu_name, full_path, path, reason from safe")
def _safe(m):
    return r.remove_safe(retention_remove(m), ROOT)


@query("remove_not_restoring", f"with recursive {FREE} select * from free")
def _not_restoring(m):
    return r.remove_not_restoring(_safe(m), m.restorelog).select("id", "dumpjob_id", "path")


@query("mark_remove", """select id, case when dumpjob_id in (select id from fx_dumpjob where status = 'HALTED') then 'NO' else keep end as keep from fx_catalog""")
def _mark(m):
    halted = m.dumpjob.filter("status = 'HALTED'").select(F.col("id").alias("dumpjob_id"))
    return r.mark_remove(m.catalog, halted).select("id", "keep")


@query("set_status", """select c.id, case when l.id is null then c.status else nullif(trim(l.v), '') end as status
from fx_catalog c left join (select id, case when status = 'ERROR' then 'FAILED' when status = 'RUNNING' then ' ' else 'SUCCESS' end as v from fx_restorelog) l on l.id = c.id""")
def _set(m):
    value = F.when(F.col("status") == "ERROR", "FAILED").when(F.col("status") == "RUNNING", " ").otherwise("SUCCESS")
    changes = m.restorelog.select("id", value.alias("value"), F.col("starttime").alias("at"))
    return r.set_column(m.catalog, changes, "status").select("id", "status")


@query("delete_ids", "select id, bu_name from fx_catalog where id not in (select id from fx_restorelog where status = 'ERROR')")
def _delete(m):
    return r.delete_ids(m.catalog, m.restorelog.filter("status = 'ERROR'")).select("id", "bu_name")


@query("dumps_per_job", "select dumpjob_id, count(*) as dumps from fx_catalog group by dumpjob_id")
def _per_job(m):
    return r.dumps_per_job(m.catalog)


@query("clean_summary", f"""with recursive {FREE},
blobs as (select checksum from fx_file group by checksum having count(*) = count(*) filter (dump_id in (select id from free)))
select 'INFO' as level, 'clean' as tool, timestamp '{NOW}' as logtime,
  'removed ' || (select count(*) from free) || ' dumps and ' || (select count(*) from blobs where checksum in (select checksum from fx_store)) || ' files from dedup store' as message,
  'CLEAN' as jobclass, -1 as jobid, '1' as bu_worker_id""")
def _summary(m):
    return clean.plan_clean(m.catalog, m.dumpjob, m.restorejob, m.restorelog, m.written("file"), m.store, NOW, ROOT).summary(worker=1)


@query("verify_candidates", "select id, dumptype, verified from fx_catalog where dumptype not like 'CLUSTER%' and status = 'SUCCESS' and verified not like 'YES'")
def _candidates(m):
    return vf.verify_candidates(m.catalog).select("id", "dumptype", "verified")


@query("verify_sample", """select id, bu_name from (
  select id, bu_name, row_number() over (order by md5(cast(id as string) || '42'), id) as rn, count(*) over () as n from fx_catalog
  where dumptype not like 'CLUSTER%' and status = 'SUCCESS' and verified not like 'YES') where rn <= round(cast(n as decimal(30,10)) * 25 / 100)""")
def _sample(m):
    return vf.verify_sample(m.catalog, 25, "42").select("id", "bu_name")


def digest_sql(columns: list[str]) -> str:
    """The four numbers of a row: md5 over its values with their lengths in front, null as ``-``."""
    row = " || ".join(f"coalesce(length(cast({c} as string)) || ':' || cast({c} as string), '-')" for c in columns)
    return ", ".join(f"sum(cast('0x' || substr(md5({row}), {k}, 8) as bigint)) as part{i}" for i, k in enumerate((1, 9, 17, 25)))


FILE_COLUMNS = ["file_id", "checksum", "size"]
MANIFEST = f"select dump_id, count(*) as row_count, part0 || '-' || part1 || '-' || part2 || '-' || part3 as content from (select dump_id, {digest_sql(FILE_COLUMNS)} from {{0}} group by dump_id) join {{0}} using (dump_id) group by all"
ALTERED = "(select file_id, dump_id, case when size % 50 = 7 then md5(checksum) else checksum end as checksum, size from fx_file)"


def altered(files):
    """The files as a bad disk would give them back: some contents differ."""
    return files.withColumn("checksum", F.when(F.col("size") % 50 == 7, F.md5("checksum")).otherwise(F.col("checksum")))


@query("verify_snapshot", f"""with a as ({MANIFEST.format('fx_file')}), b as ({MANIFEST.format(ALTERED)})
select a.dump_id, a.row_count = b.row_count and a.content = b.content as ok from a join b on a.dump_id is not distinct from b.dump_id""")
def _verify(m):
    files = m.written("file")
    manifest = vf.fingerprint(files, "dump_id", FILE_COLUMNS, portable=True)
    return vf.verify_snapshot(manifest, vf.fingerprint(altered(files), "dump_id", FILE_COLUMNS, portable=True), "dump_id")


LEAVES = 256
DISK = "(select file_id, dump_id, case when size % 997 = 7 then md5(checksum) else checksum end as checksum, size from fx_file where file_id % 401 <> 3)"


@query("verify_ranges", f"""with edge as (select min(file_id) as lo, max(file_id) - min(file_id) + 1 as n from fx_file),
a as (select (file_id - lo) * {LEAVES} // n as leaf, count(*) as row_count, {digest_sql(FILE_COLUMNS)} from fx_file, edge group by 1),
b as (select (file_id - lo) * {LEAVES} // n as leaf, count(*) as found_count, {digest_sql(FILE_COLUMNS)} from {DISK}, edge group by 1)
select cast(a.leaf as bigint) as leaf, cast(lo + (a.leaf * n + {LEAVES} - 1) // {LEAVES} as bigint) as first_key, cast(lo + ((a.leaf + 1) * n + {LEAVES} - 1) // {LEAVES} - 1 as bigint) as last_key,
  row_count, coalesce(found_count, 0) as found_count
from a left join b on a.leaf = b.leaf, edge
where b.leaf is null or row_count <> found_count or a.part0 <> b.part0 or a.part1 <> b.part1 or a.part2 <> b.part2 or a.part3 <> b.part3""")
def _ranges(m):
    files = m.written("file")
    low, high = vf.key_ranges(files, "file_id")
    disk = files.withColumn("checksum", F.when(F.col("size") % 997 == 7, F.md5("checksum")).otherwise(F.col("checksum"))).filter("file_id % 401 <> 3")
    sums = [vf.range_sums(df, "file_id", FILE_COLUMNS, low, high, LEAVES, portable=True) for df in (files, disk)]
    return vf.damaged_ranges(*sums, low, high, LEAVES)


@query("verify_rows", f"""select e.file_id, case when d.file_id is null then 'missing' else 'changed' end as problem
from fx_file e left join {DISK} d using (file_id) where d.file_id is null or d.checksum is distinct from e.checksum""")
def _rows(m):
    files = m.written("file")
    low, high = vf.key_ranges(files, "file_id")
    disk = files.withColumn("checksum", F.when(F.col("size") % 997 == 7, F.md5("checksum")).otherwise(F.col("checksum"))).filter("file_id % 401 <> 3")
    sums = [vf.range_sums(df, "file_id", FILE_COLUMNS, low, high) for df in (files, disk)]
    return vf.damaged_rows(files, disk, "file_id", FILE_COLUMNS, vf.damaged_ranges(*sums, low, high), low, high)


@query("verify_apply", f"""with a as ({MANIFEST.format('fx_file')}), b as ({MANIFEST.format(ALTERED)}),
res as (select a.dump_id as id, a.content = b.content as ok from a join b on a.dump_id = b.dump_id)
select c.id, case when not r.ok then 'FAILED' else c.status end as status,
  case when r.ok then 'YES' when not r.ok then 'FAILED' else c.verified end as verified,
  case when not r.ok then 'backup ' || c.bu_name || ' reported SUCCESS, verification reported ERROR' end as message
from fx_catalog c left join res r on r.id = c.id""")
def _apply(m):
    results = _verify(m).withColumnRenamed("dump_id", "id")
    after = vf.verify_apply(m.catalog, results)
    messages = vf.verify_messages(m.catalog, results, NOW, 1).select(F.col("jobid"), F.col("message").alias("text"))
    return after.join(messages, F.col("id") == F.col("jobid"), "left").select("id", "status", "verified", F.col("text").alias("message"))
