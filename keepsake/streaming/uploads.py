"""The upload spool and the logs as streams (ST1, ST2).

Files that were loaded are remembered by the checkpoint instead of being deleted. Each
micro-batch writes to a folder of its own number and overwrites it when it is run
again, so every file counts exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.operators import extract
from keepsake.sources import textfiles


def _spool_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def stream_upload(
    spark: SparkSession, spool: str, out: str, checkpoint: str, max_files: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Spool to ``out/message``, ``out/catalog`` and ``out/rejects``; by default it runs until the spool is read.

    ``trigger`` holds the arguments of Spark's trigger, such as ``{"processingTime": "5 minutes"}``.
    """

    def load(batch: DataFrame, number: int) -> None:
        judged = textfiles.judge(textfiles.route(batch)).persist()
        try:
            for target in textfiles.TARGETS:
                textfiles.accepted(judged, target).write.mode("overwrite").parquet(f"{out}/{target}/batch_id={number}")
            textfiles.rejected(judged).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={number}")
        finally:
            judged.unpersist()

    return (
        _spool_stream(spark, spool, max_files).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_log_messages(
    spark: SparkSession, logs: str, out: str, checkpoint: str, worker, max_files: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Log files to message rows in ``out``; stateless, so the file sink is enough."""
    rows = extract.log_to_message(_spool_stream(spark, logs, max_files).select("line"), worker)
    return (
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
