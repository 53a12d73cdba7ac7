"""Streams with keyed state in the state store (ST3, ST4).

Both follow event time. The clock of a stream is the latest time seen minus ``lateness``; what
happened before the clock is taken to have arrived. A job's rows are held until the clock has
passed them and are then compared in order; a run's end is remembered until the clock has passed
it, so that an end that overtakes its start still closes it. Timers of the state store do this
key by key, so a batch touches the keys it has rows or due timers for, and nothing else.

State, offsets and output are committed together by the engine: a stream that is stopped or fails
goes on from its checkpoint, each result is written once. Nothing is dropped for being late. A row
that comes too late to be put in order is written with ``late`` set, and changes no state.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from keepsake.sources import folders

# Processors travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATUS_SCHEMA = "job_id int, at timestamp_ntz, event_id bigint, status string"
CHANGE_SCHEMA = "job_id int, at timestamp_ntz, event_id bigint, old_status string, status string, late boolean"
ACTIVITY_SCHEMA = "seq bigint, at timestamp_ntz, worker_id int, process_id int, op string"
RUN_SCHEMA = "worker_id int, process_id int, at timestamp_ntz, seq bigint, op string, late boolean"
LATENESS = "1 hour"
EPOCH, BEFORE_ALL = dt.datetime(1970, 1, 1), dt.datetime(1, 1, 1)


def _millis(at: dt.datetime | None) -> int:
    """Time of a row for the clock; a row without time lies before all others."""
    return ((at or BEFORE_ALL) - EPOCH) // dt.timedelta(milliseconds=1)


def _due(at: dt.datetime | None) -> int:
    """Timer that is due when the clock has passed a time."""
    return max(_millis(at) + 1, 1)


class StatusChanges(StatefulProcessor):
    """The last status of a job, and the rows of the job that the clock has not passed."""

    ROW = "at timestamp_ntz, event_id bigint, status string"

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.ROW)
        self.held = handle.getListState("held", self.ROW)

    @staticmethod
    def order(row) -> tuple:
        return row[0] or BEFORE_ALL, row[1] is not None, row[1] or 0, row[2] is not None, row[2] or ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter([])
        fresh = [(r["at"], r["event_id"], r["status"]) for r in rows]
        self.held.appendList(fresh)
        self.handle.registerTimer(min(_due(r[0]) for r in fresh))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.held.get()]
        passed = sorted((r for r in held if _millis(r[0]) < clock), key=self.order)
        if not passed:
            return
        open_rows = [r for r in held if _millis(r[0]) >= clock]
        if open_rows:
            self.held.put(open_rows)
            self.handle.registerTimer(min(_due(r[0]) for r in open_rows))
        else:
            self.held.clear()
        last = self.last.get()
        last = None if last is None else tuple(last)
        for row in passed:
            late = last is not None and self.order(row) < self.order(last)
            changed = last is not None and None not in (row[2], last[2]) and row[2] != last[2]
            if late or changed:
                yield Row(job_id=key[0], at=row[0], event_id=row[1], old_status=None if late else last[2], status=row[2], late=late)
            if not late:
                last = row
        self.last.update(last)

    def close(self) -> None:
        pass


class OpenRuns(StatefulProcessor):
    """The last operation of a process: a start is an open run, an end stays until the clock has passed it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp_ntz, seq bigint, op string")

    @staticmethod
    def order(row) -> tuple:
        return row[0] or BEFORE_ALL, row[1] is not None, row[1] or 0, row[2] or ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if None in tuple(key):
            return
        clock = timerValues.getCurrentWatermarkInMs()
        before = self.last.get()
        last = None if before is None else tuple(before)
        for r in rows:
            row = r["at"], r["seq"], r["op"]
            if last is None and clock > 0 and _millis(row[0]) < clock:
                # its end may have come and gone
                if row[2] == "START":
                    yield Row(worker_id=key[0], process_id=key[1], at=row[0], seq=row[1], op=row[2], late=True)
            elif last is None or self.order(row) > self.order(last):
                last = row
        if last is None or (before is not None and last == tuple(before)):
            return
        self.last.update(last)
        if last[2] != "START":
            self.handle.registerTimer(_due(last[0]))
        yield Row(worker_id=key[0], process_id=key[1], at=last[0], seq=last[1], op=last[2], late=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()
        if last is not None and last[2] != "START" and _millis(last[0]) < timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def _source(spark: SparkSession, folder: str, schema: str, max_files: int | None, lateness: str) -> DataFrame:
    """Rows of a folder with a clock. The clock's column is left out behind it, so that late rows go on."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(folder)
    return rows.withColumn("clock", F.col("at").cast("timestamp_ltz")).withWatermark("clock", lateness).select(*rows.columns)


def _run(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start(out)
    )


def advance(spark: SparkSession, source: str, at: Column, schema: str) -> None:
    """Move the clock of a stream's source on, by a row of no key: all before ``at`` minus the lateness is complete."""
    names = [f.split()[0] for f in schema.split(", ")]
    row = spark.range(1).select(*[(at if n == "at" else F.lit(None)).alias(n) for n in names])
    staged = folders.beside(f"{source}/clock")
    row.selectExpr(*[f"cast({f.split()[0]} as {f.split()[1]}) as {f.split()[0]}" for f in schema.split(", ")]).write.parquet(staged)
    folders.move(spark, staged, f"{source}/clock{staged.rsplit('.', 1)[1]}")


def stream_status_changes(
    spark: SparkSession, source: str, out: str, checkpoint: str, max_files: int | None = None,
    lateness: str = LATENESS, trigger: dict | None = None,
) -> StreamingQuery:
    """Status history to ``out`` as rows of ``CHANGE_SCHEMA``, each when the clock has passed it.

    Rows without a job count for the clock only. ``trigger`` holds the arguments of Spark's trigger.
    """
    rows = _source(spark, source, STATUS_SCHEMA, max_files, lateness)
    changes = rows.groupBy("job_id").transformWithState(StatusChanges(), CHANGE_SCHEMA, "Append", "EventTime")
    return _run(changes, out, checkpoint, trigger)


def changes_of(spark: SparkSession, out: str, late: bool = False) -> DataFrame:
    """The changes a stream has written, or the rows that came too late for it."""
    rows = spark.read.schema(CHANGE_SCHEMA).parquet(out).filter(F.col("late") == late)
    return rows.drop("late") if not late else rows.drop("late", "old_status")


def stream_activity(
    spark: SparkSession, source: str, out: str, checkpoint: str, max_files: int | None = None,
    lateness: str = LATENESS, trigger: dict | None = None,
) -> StreamingQuery:
    """Starts and ends of runs to ``out`` as a log of ``RUN_SCHEMA``: what each process did last, whenever that changes."""
    rows = _source(spark, source, ACTIVITY_SCHEMA, max_files, lateness)
    runs = rows.groupBy("worker_id", "process_id").transformWithState(OpenRuns(), RUN_SCHEMA, "Append", "EventTime")
    return _run(runs, out, checkpoint, trigger)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key.*", "value.*")


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The runs that are open as of the last batch, read from the state store."""
    return _state(spark, checkpoint, "last").filter("op = 'START'").select(
        "worker_id", "process_id", F.col("at").alias("starttime"), "seq"
    )


def kept_processes(spark: SparkSession, checkpoint: str) -> int:
    """How many processes the state store holds: open runs, and ends that the clock has not passed."""
    return _state(spark, checkpoint, "last").count()


def last_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last status of every job as of the last batch."""
    return _state(spark, checkpoint, "last").select("job_id", "at", "event_id", "status")
