"""A place where dumps are kept: snapshots, the store of their contents, link counts, and the tables about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from keepsake.functions import scalars as s
from keepsake.operators import retention
from keepsake.sources import linkcounts, vault, versions
from keepsake.sources.schemas import conform, schema_of


@dataclass(frozen=True)
class Home:
    spark: SparkSession
    base: str

    @property
    def root(self) -> str:
        return f"{self.base}/snapshots"

    @property
    def store(self) -> str:
        return f"{self.base}/store"

    @property
    def links(self) -> str:
        return f"{self.base}/links"

    def table(self, name: str) -> DataFrame:
        return versions.read(self.spark, f"{self.base}/tables/{name}", schema_of(name))

    def put(self, name: str, rows: DataFrame) -> None:
        """The next version of a table."""
        versions.put(conform(rows, name), f"{self.base}/tables/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows added to the table's last version; nothing of it is written again."""
        versions.append(conform(rows, name), f"{self.base}/tables/{name}")

    def set_value(self, name: str, row_id: int, column: str, value: str) -> None:
        change = self.spark.range(1).select(
            F.lit(row_id).cast("int").alias("id"), F.lit(value).alias("value"), F.lit(None).cast("timestamp_ntz").alias("at"))
        self.put(name, retention.set_column(self.table(name), change, column))

    def say(self, level: str, tool: str, at, message: str, jobclass: str, job: int, worker) -> None:
        row = self.spark.createDataFrame([(level, tool, message, jobclass, job, str(worker))], "level string, tool string, message string, jobclass string, jobid int, bu_worker_id string")
        self.append("message", row.withColumn("logtime", s.moment(at)))

    def take_in(self, snapshot: str) -> None:
        """Deduplicate a snapshot and count its links."""
        vault.take_in(self.spark, snapshot, self.store)
        linkcounts.add(vault.files(self.spark, snapshot), self.links, snapshot.rsplit("/", 1)[1])
