"""Spark session settings shared by every job of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Times are zone-free end to end, and
# skewed joins are split even when that costs an extra shuffle downstream.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # keyed state of streams, on disk beside the executors and in the checkpoint
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else made."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """Session for local runs; on a cluster ``master`` comes from spark-submit."""
    builder = SparkSession.builder.appName("keepsake")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_written: list[str] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name for written intermediate tables.

    The shared folder is the one the cluster names in ``spark.checkpoint.dir``.
    Only where that is unset (tests, laptops) a local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="keepsake-")
    path = os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def drop_work(spark: SparkSession) -> None:
    """Remove the intermediate tables this process has written, when no result needs them any more."""
    from keepsake.sources import folders

    while _written:
        folders.drop(spark, _written.pop())


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """A run whose intermediate tables go at its end; its results have to be written by then."""
    from keepsake.sources import folders

    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            folders.drop(spark, _written.pop())


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several steps need, once, and go on from the written table.

    Its lineage is cut, a lost executor costs only a read, and its file size tells the
    planner whether it may be broadcast or has to be joined by a shuffle.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
