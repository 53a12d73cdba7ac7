"""Keyed-state streams: any order of arrival, late rows, restarts, hot keys."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import jobs
from keepsake.streaming import states

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """A stream keeps the number of state partitions it starts with."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """A source folder, and a stream over it that is stopped after every arrival."""

    def __init__(self, spark, path, start, schema):
        self.spark, self.start, self.schema, self.arrivals = spark, start, schema, 0
        self.source, self.out, self.mark = (str(path / n) for n in ("source", "out", "mark"))

    def put(self, rows, **options):
        self.arrivals += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.source}/{self.arrivals}")
        self.run(**options)

    def run(self, **options):
        self.start(self.spark, self.source, self.out, self.mark, **options).awaitTermination()

    def finish(self, minutes=10 ** 6):
        states.advance(self.spark, self.source, F.lit(str(at(minutes))).cast("timestamp_ntz"), self.schema)
        self.run()

    def changes(self, late=False):
        names = ("job_id", "event_id", "status") if late else ("job_id", "event_id", "old_status", "status")
        return sorted(tuple(r[n] for n in names) for r in states.changes_of(self.spark, self.out, late).collect())


def test_status_changes_in_any_order(spark, tmp_path):
    rows = []
    for i in range(1500):
        job = 1 if i % 3 else (None if i % 60 == 0 else i % 20)
        rows.append((job, at(i // 2), i, None if i % 17 == 0 else "ABC"[(i * 7919) % 3]))
    want = sorted((r.job_id, r.event_id, r.old_status, r.status) for r in jobs.status_changes(spark.createDataFrame(rows, states.STATUS_SCHEMA)).collect())
    # rows come up to 200 minutes out of order, within the lateness
    mixed = [r for _, r in sorted(((i + random.Random(i).randrange(400), r) for i, r in enumerate(rows)), key=lambda x: x[0])]
    feed = Feed(spark, tmp_path, states.stream_status_changes, states.STATUS_SCHEMA)
    for k in range(3):
        feed.put(mixed[k * 500:(k + 1) * 500], lateness="4 hours")
    feed.finish()
    assert feed.changes() == want and feed.changes(late=True) == []
    # each change was written once, and no state is left but one row a job
    assert states.last_status(spark, feed.mark).count() == len({r[0] for r in rows} - {None})


def test_status_changes_late_rows_and_rows_without_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, states.stream_status_changes, states.STATUS_SCHEMA)
    feed.put([(1, None, 1, "A"), (1, at(0), 2, "B"), (1, at(600), 3, "C"), (2, at(0), 4, "A")])
    feed.put([(2, at(2), 5, "B"), (3, at(601), 6, "A")])
    assert feed.changes() == [(1, 2, "A", "B"), (2, 5, "A", "B")]  # the clock stands at 9 hours, 600 minutes are not over
    # behind the clock: still in order for its job, or late
    feed.put([(2, at(3), 7, "C"), (1, at(-5), 8, "X"), (1, at(1), 9, "A")])
    feed.finish()
    assert feed.changes() == [(1, 2, "A", "B"), (1, 3, "A", "C"), (1, 9, "B", "A"), (2, 5, "A", "B"), (2, 7, "B", "C")]
    assert feed.changes(late=True) == [(1, 8, "X")]
    feed.run()
    assert len(feed.changes()) == 5  # a run without news writes nothing again


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    """A batch whose results were not committed is run again from the same state."""
    feed = Feed(spark, tmp_path, states.stream_status_changes, states.STATUS_SCHEMA)
    feed.put([(1, at(0), 1, "A"), (1, at(500), 2, "B")])
    feed.put([(1, at(501), 3, "A"), (1, at(900), 4, "B")])
    commits = f"{feed.mark}/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    feed.finish()
    assert feed.changes() == [(1, 2, "A", "B"), (1, 3, "B", "A"), (1, 4, "A", "B")]


def test_trigger_is_an_argument(spark, tmp_path):
    feed = Feed(spark, tmp_path, states.stream_status_changes, states.STATUS_SCHEMA)
    feed.put([(1, at(0), 1, "A"), (1, at(1), 2, "B")])
    query = states.stream_status_changes(spark, feed.source, feed.out, feed.mark, trigger={"processingTime": "1 second"})
    try:
        states.advance(spark, feed.source, F.lit(str(at(10 ** 5))).cast("timestamp_ntz"), feed.schema)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert feed.changes() == [(1, 2, "A", "B")]


def test_open_runs_in_any_order(spark, tmp_path):
    events = []
    for p in range(60):
        for k in range(6):
            events.append((p * 6 + k, at(k * 20 + p % 15), p % 4, p, "START" if k % 2 == 0 else "END"))
    events = [e for e in events if not (e[3] % 5 == 0 and e[0] % 6 == 5)]
    want = sorted((r.worker_id, r.process_id, r.seq) for r in jobs.running_activity(spark.createDataFrame(events, states.ACTIVITY_SCHEMA)).collect())
    assert len(want) == 12
    for seed in (1, 2):
        random.Random(seed).shuffle(events)
        feed = Feed(spark, tmp_path / str(seed), states.stream_activity, states.ACTIVITY_SCHEMA)
        for k in range(3):
            feed.put(events[k::3], lateness="3 hours")
        got = states.open_runs(spark, feed.mark)
        assert sorted((r.worker_id, r.process_id, r.seq) for r in got.collect()) == want
    assert states.kept_processes(spark, feed.mark) == 60  # ends that the clock has not passed are kept
    feed.finish()
    assert states.kept_processes(spark, feed.mark) == len(want)
    assert sorted((r.worker_id, r.process_id, r.seq) for r in states.open_runs(spark, feed.mark).collect()) == want


def test_open_runs_end_before_start_and_late_start(spark, tmp_path):
    feed = Feed(spark, tmp_path, states.stream_activity, states.ACTIVITY_SCHEMA)
    feed.put([(2, at(10), 1, 7, "END"), (3, at(10), 1, 8, "START"), (9, at(10), None, 8, "START")])
    feed.put([(1, at(5), 1, 7, "START")])
    assert [(r.worker_id, r.process_id) for r in states.open_runs(spark, feed.mark).collect()] == [(1, 8)]
    feed.put([(4, at(1000), 1, 9, "START")])
    feed.put([(0, at(4), 1, 7, "START"), (5, at(20), 1, 8, "END")])  # long after the end of 7 was let go
    assert [(r.worker_id, r.process_id) for r in states.open_runs(spark, feed.mark).collect()] == [(1, 9)]
    log = spark.read.schema(states.RUN_SCHEMA).parquet(feed.out)
    assert [(r.process_id, r.seq) for r in log.filter("late").collect()] == [(7, 0)]
