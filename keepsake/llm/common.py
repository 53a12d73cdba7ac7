"""Session settings and small DataFrame helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.session import configure

BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings plus small Arrow batches: texts are long, so rows per batch bound memory."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it; Spark compares names without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % modulus


def held_out(key: str, modulus: int, value: int) -> Column:
    """Rows kept apart from learning. A null id is never held out."""
    return F.coalesce(remainder(key, modulus) == value, F.lit(False))


def bytes_of(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: one number from one pass."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def blocks_for(size: int, block: int) -> int:
    """Number of blocks of about ``block`` bytes; it grows with the data."""
    return max(1, -(-size // block))


def block_of(n: int, *columns: str) -> Column:
    """Block of a row by the hash of its columns, so that no source or run of ids fills one block."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def summed_slices(rows: DataFrame, dtype: str) -> dict[int, bytes]:
    """Sum of the tasks' counter slices ``slice, part, counters``, in two steps: slice -> int64 bytes.

    A slice has a fixed number of counters, so what reaches one task and the driver is bounded.
    """
    import numpy as np
    import pyarrow as pa

    def adder(kind: str):
        def add(key, table):
            total = sum((np.frombuffer(x, kind).astype(np.int64) for x in table["counters"].to_pylist()), np.int64(0))
            return table.slice(0, 1).select(["slice", "part"]).append_column("counters", pa.array([total.tobytes()], pa.binary()))

        return add

    for keys, kind in ((["slice", "part"], dtype), (["slice"], "int64")):
        rows = rows.groupBy(*keys).applyInArrow(adder(kind), "slice int, part int, counters binary")
    return {r["slice"]: bytes(r["counters"]) for r in rows.collect()}
