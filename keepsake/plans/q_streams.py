"""Registered queries that run a stream over files written from the tables and read its result."""

from pyspark.sql import DataFrame, functions as F

from keepsake.plans.q_extract import LOG_LINE, log_lines
from keepsake.plans.q_files import PARSED, VALID, write_spool
from keepsake.plans.q_jobs import RUNNING
from keepsake.plans.registry import query
from keepsake.session import work_dir
from keepsake.streaming import states, uploads


@query("stream_upload", f"""select 'message' as kind, count(*) as n, cast(sum(jobid) as bigint) as id_sum from ({PARSED})
union all select 'catalog', count(*), cast(sum(dumpjob_id) as bigint) from fx_catalog
union all select 'rejects', (select count(*) from fx_upload where not {VALID}) + (select count(*) from region), null""")
def _upload(m):
    spool, out = write_spool(m), work_dir(m.spark, "loaded")
    uploads.stream_upload(m.spark, spool, out, work_dir(m.spark, "checkpoint")).awaitTermination()
    read = m.spark.read.parquet

    def row(kind, df, total):
        return df.agg(F.count(F.lit(1)).alias("n"), total.alias("id_sum")).select(F.lit(kind).alias("kind"), "n", "id_sum")

    none = F.max(F.lit(None).cast("bigint"))
    return row("message", read(f"{out}/message"), F.sum("jobid")).unionByName(
        row("catalog", read(f"{out}/catalog"), F.sum("dumpjob_id"))).unionByName(row("rejects", read(f"{out}/rejects"), none))


@query("stream_log_messages", f"""select date_trunc('second', logtime) as logtime, level, tool, message, 'CACHE_CONFIG' as jobclass, -1 as jobid, '3' as bu_worker_id
from fx_message where regexp_matches({LOG_LINE}, 'WARNING|ERROR')""")
def _logs(m):
    logs, out = work_dir(m.spark, "logs"), work_dir(m.spark, "log-messages")
    log_lines(m.message).select("line").repartition(3).write.text(logs)
    uploads.stream_log_messages(m.spark, logs, out, work_dir(m.spark, "checkpoint"), worker=3, max_files=1).awaitTermination()
    return m.spark.read.parquet(out)


def in_thirds(df: DataFrame) -> list[DataFrame]:
    """All rows in three parts by time, for three arrivals; rows without time come with the first."""
    lo, hi = df.agg(F.min("at"), F.max("at")).first()
    if lo is None:
        return [df]
    cuts = [F.lit(str(lo + (hi - lo) * k / 3)).cast("timestamp_ntz") for k in (1, 2)]
    return [
        df.filter((F.col("at") < cuts[0]) | F.col("at").isNull()),
        df.filter((F.col("at") >= cuts[0]) & (F.col("at") < cuts[1])), df.filter(F.col("at") >= cuts[1]),
    ]


def arrive(m, rows: DataFrame, schema: str, start) -> tuple[str, str]:
    """Run a stream over three arrivals, stopped after each, and once more when the clock has passed all; (out, checkpoint)."""
    source, out, mark = (work_dir(m.spark, n) for n in ("arriving", "streamed", "checkpoint"))
    for k, part in enumerate(in_thirds(rows)):
        part.write.parquet(f"{source}/{k}")
        start(m.spark, source, out, mark).awaitTermination()
    states.advance(m.spark, source, F.lit("9999-01-01 00:00:00").cast("timestamp_ntz"), schema)
    start(m.spark, source, out, mark).awaitTermination()
    return out, mark


@query("stream_status_changes", """select job_id, "at", event_id, old_status, status from (
  select *, lag(status) over (partition by job_id order by "at", event_id) as old_status from fx_status) where status <> old_status""")
def _status(m):
    out, _ = arrive(m, m.status, states.STATUS_SCHEMA, states.stream_status_changes)
    return states.changes_of(m.spark, out)


@query("stream_activity", RUNNING)
def _activity(m):
    _, mark = arrive(m, m.activity, states.ACTIVITY_SCHEMA, states.stream_activity)
    return states.open_runs(m.spark, mark)
