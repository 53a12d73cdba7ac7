"""Registered queries: one per column function, each over a whole table."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as s
from keepsake.plans.registry import NOW, query


@query("concat_null", "select id, cast(dumpjob_id as string) || '/' || message as v from fx_catalog")
def _f1(m):
    return m.catalog.select("id", s.concat_null("dumpjob_id", F.lit("/"), "message").alias("v"))


@query("cut_text", "select id, substr(message, 1, 1) as v1, substr(message, 1, 32) as v32, substr(message, 1, 64) as v64 from fx_catalog")
def _f2(m):
    return m.catalog.select("id", *[s.cut_text("message", n).alias(f"v{n}") for n in (1, 32, 64)])


@query("fmt_time", """select id, strftime(starttime, '%Y-%m-%d %H:%M:%S') as sec, strftime(starttime, '%Y-%m-%d') as day,
  strftime(starttime, '%Y-%m-%d') || chr(10) || strftime(starttime, '%H:%M:%S') as two from fx_catalog""")
def _f3(m):
    return m.catalog.select("id", s.fmt_time("starttime").alias("sec"), s.fmt_time("starttime", s.DATE_FORMAT).alias("day"),
                            s.fmt_time("starttime", s.TWO_LINE_FORMAT).alias("two"))


@query("duration", "select id, datediff('second', starttime, endtime) as v from fx_restorelog")
def _f4(m):
    return m.restorelog.select("id", s.duration("starttime", "endtime").alias("v"))


@query("age_filter", f"select id from fx_catalog where timestamp '{NOW}' - starttime < 1000 * interval '1' hour")
def _f5(m):
    return m.catalog.filter(s.age_filter("starttime", NOW, 1000)).select("id")


@query("split_part", "select id, split_part(bu_path, '/', 4) as a, split_part(dest_dbname || '.' || restoreschema, '.', 2) as b from fx_restorelog")
def _f6(m):
    return m.restorelog.select("id", s.split_part("bu_path", "/", 4).alias("a"),
                               s.split_part(s.db_schema("dest_dbname", "restoreschema"), ".", 2).alias("b"))


@query("regex_split", "select db_id, split_part(replace(datacl, '/', '='), '=', 2) as v from fx_acl")
def _f7(m):
    return m.acl.select("db_id", s.regex_split("datacl", "[=/]", 2).alias("v"))


@query("explode_list", """select id, cast(unnest(string_split(restorejob_id, ',')) as int) as v from fx_dumpjob where restorejob_id <> ''""")
def _f8(m):
    return m.dumpjob.select("id", F.explode(s.id_list("restorejob_id")).alias("v"))


@query("null_default", "select id, coalesce(message, 'none') as v, coalesce(message, bu_name) as w from fx_catalog")
def _f9(m):
    return m.catalog.select("id", s.null_default("message", "none").alias("v"), s.null_default("message", F.col("bu_name")).alias("w"))


@query("lower_key", "select id, lower(dumpschema) as v from fx_dumpjob")
def _f10(m):
    return m.dumpjob.select("id", s.lower_key("dumpschema").alias("v"))


@query("schedule_label", "select id, case when jobtype = 'TRIGGER' then jobtype else substr(jobtype, 1, 1) || '/' || cron end as v from fx_restorejob")
def _f11(m):
    return m.restorejob.select("id", s.schedule_label("jobtype", "cron").alias("v"))


@query("quote_ident", r"""select id, case when regexp_matches(restoreschema, '^[\*_0-9a-z]+$') then restoreschema else '"' || restoreschema || '"' end as v from fx_restorejob""")
def _f12(m):
    return m.restorejob.select("id", s.quote_ident("restoreschema").alias("v"))


@query("strip_quotes", """select line_no, trim(replace(split_part(line, ' ', -1), ';', ''), '"') as v from fx_ddl""")
def _f13(m):
    return m.ddl.select("line_no", s.strip_quotes(F.replace(F.split_part("line", F.lit(" "), F.lit(-1)), F.lit(";"), F.lit(""))).alias("v"))


@query("version_code", """select id, case when id % 14 < 10 then cast(id % 14 as string) || cast(id % 7 as string) else cast(id % 14 as string) end as v from fx_catalog""")
def _f14(m):
    return m.catalog.select("id", s.version_code(s.concat_null(F.col("id") % 14, F.lit("."), F.col("id") % 7, F.lit(".1"))).alias("v"))


@query("blank_to_null", "select id, nullif(restoreoptions, '') as v from fx_restorejob")
def _f15(m):
    return m.restorejob.select("id", s.blank_to_null("restoreoptions").alias("v"))


@query("strip_extension", "select id, replace(bu_name, '.sql.gz', '') as v from fx_catalog")
def _f16(m):
    return m.catalog.select("id", s.strip_extension("bu_name").alias("v"))


@query("blob_path", "select file_id, substr(checksum, 1, 1) || '/' || substr(checksum, 2, 1) || '/' || checksum as v from fx_file")
def _f17(m):
    return m.file.select("file_id", s.blob_path("checksum").alias("v"))


@query("checksum", "select doc_id, md5(text) as v, sha256(text) as w from documents")
def _f18(m):
    return m.documents.select("doc_id", s.checksum("text").alias("v"), s.checksum("text", 256).alias("w"))


@query("window_length", "select id, bu_window_start as start_hour, cast((bu_window_end - bu_window_start + 24) % 24 * 60 as int) as length_min from fx_instance")
def _f19(m):
    return m.instance.select("id", F.col("bu_window_start").alias("start_hour"),
                             s.window_length("bu_window_start", "bu_window_end").cast("int").alias("length_min"))


@query("random_cron", """select id, cast(t % 60 as string) || ' ' || cast(t // 60 as string) || ' * * *' as v from (
  select id, (bu_window_start * 60 + cast('0x' || substr(md5(cast(id as string)), 1, 8) as bigint) % ((bu_window_end - bu_window_start + 24) % 24 * 60 + 1)) % 1440 as t from fx_instance)""")
def _f20(m):
    return m.instance.select("id", s.random_cron("id", "bu_window_start", "bu_window_end").alias("v"))


@query("numeric_round", "select id, cast(round(cast(id as decimal(30,10)) * 25 / 100) as bigint) as v from fx_catalog")
def _f21(m):
    return m.catalog.select("id", s.numeric_round(F.col("id").cast("decimal(20,0)") * 25 / 100).alias("v"))


@query("percent_text", "select id, cast(cast(round_even(cast(dumpsize as double) / nullif(cast(dbsize as double), 0) * 100, 0) as bigint) as string) as v from fx_catalog")
def _f22(m):
    return m.catalog.select("id", s.percent_text("dumpsize", "dbsize").alias("v"))


@query("overlap_instant", f"select id, starttime <= timestamp '{NOW}' and timestamp '{NOW}' < endtime as v, starttime <= date_trunc('hour', endtime) and date_trunc('hour', endtime) < endtime as w from fx_catalog")
def _f23(m):
    return m.catalog.select("id", s.overlap_instant("starttime", "endtime", s.moment(NOW)).alias("v"),
                            s.overlap_instant("starttime", "endtime", F.date_trunc("hour", "endtime").cast("timestamp_ntz")).alias("w"))


@query("array_collect", """select id, coalesce(list_contains(parts, '5'), false) as has_5, coalesce(len(parts), 0) as n
from (select id, string_split(nullif(restorejob_id, ''), ',') as parts from fx_dumpjob)""")
def _f24(m):
    ids = s.id_list("restorejob_id")
    return m.dumpjob.select("id", F.array_contains(ids, 5).alias("has_5"), F.size(ids).cast("bigint").alias("n"))


@query("compact_stamp", "select id, strftime(starttime, '%Y%m%dT%H%M%S') || '+0000' as v, starttime as back from fx_catalog")
def _f25(m):
    return m.catalog.select("id", s.compact_stamp("starttime").alias("v"), s.parse_stamp(s.compact_stamp("starttime")).alias("back"))


@query("like_match", "select id, message like '%order 1%' as v, not (message like 'auto%') as w from fx_catalog")
def _f26(m):
    return m.catalog.select("id", s.like_match("message", "%order 1%").alias("v"), (~s.like_match("message", "auto%")).alias("w"))


@query("snapshot_name", """select id, cast(id as string) || '_' || dbname || case when dumpschema = '*' or dumptype = 'SCRIPT' then '' else '.' || dumpschema end
  || '_' || dumptype || '_20010330T120000' as v from fx_dumpjob""")
def _f27(m):
    return m.dumpjob.select("id", s.snapshot_name("id", "dbname", "dumpschema", "dumptype", F.lit("20010330T120000")).alias("v"))
