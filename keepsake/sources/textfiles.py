"""Text sources and sinks: cached lists, exports, the upload spool."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from keepsake.functions import scalars as s
from keepsake.operators import audit
from keepsake.sources import folders, taskfiles
from keepsake.sources.schemas import schema_of

# Column order of the upload formats.
MESSAGE_FIELDS = ["logtime", "level", "tool", "message", "jobclass", "jobid", "bu_worker_id"]
CATALOG_FIELDS = [
    "dumpjob_id", "starttime", "endtime", "status", "bu_name", "bu_location", "dbsize", "dumpsize", "dbname",
    "dumpschema", "dumptype", "bu_extension", "pgversion", "bu_worker_id", "message", "pgsql_dns_name", "pgsql_port",
]
TARGETS = {"message": MESSAGE_FIELDS, "catalog": CATALOG_FIELDS}
# Fixed value: ending of dump data files.
DATA_FILES = "*.dat.gz"
# A spool entry is a file, or a folder that Spark wrote, named ``<anything>.<target>.dat``.
SPOOL_PATTERN = r"\.([^./]+)\.dat(?:/[^/]*)?$"


def _plain(df: DataFrame, name: str, true: str = "t", false: str = "f") -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        c = F.when(c, F.lit(true)).when(~c, F.lit(false))
    return F.coalesce(c.cast("string"), F.lit(""))


def export_pipe(df: DataFrame, path: str) -> None:
    """Headerless ``|`` lines, nothing quoted, nulls empty; a list that is there is replaced at the end."""
    spark = df.sparkSession
    staged = folders.beside(path)
    df.select(F.concat_ws("|", *[_plain(df, c) for c in df.columns]).alias("value")).write.text(staged)
    folders.replace(spark, staged, path)


def read_pipe(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Positional ``|`` fields with types; an empty field is null unless it is text."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parts = F.split(F.col("value"), r"\|")
    return spark.read.text(path).select(
        *[
            (F.get(parts, i) if isinstance(f.dataType, T.StringType) else F.nullif(F.get(parts, i), F.lit("")).cast(f.dataType)).alias(f.name)
            for i, f in enumerate(schema.fields)
        ]
    )


def export_tsv(df: DataFrame, path: str) -> None:
    """A header and tab-separated lines, values bare as they are, nulls as ``None``, booleans as ``True`` and ``False``."""
    values = [F.coalesce(F.when(F.col(c).isNotNull(), _plain(df, c, "True", "False")), F.lit("None")) for c in df.columns]
    header = df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string").coalesce(1)
    header.unionByName(df.select(F.concat_ws("\t", *values).alias("value"))).write.text(path)


def file_inventory(spark: SparkSession, path: str, pattern: str = DATA_FILES) -> DataFrame:
    """(path, checksum, size) of the data files below a folder.

    The session lists the files; tasks stream them, so a file of any size takes the memory of a piece.
    """
    found = taskfiles.checksums(taskfiles.listing(spark, path, pattern))
    return found.withColumn("path", F.regexp_replace("path", r"\s+", " "))


def table_inventory(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """The same for contents that are rows of a table."""
    return df.select(
        F.regexp_replace(path, r"\s+", " ").alias("path"), F.md5(content).alias("checksum"),
        F.octet_length(content).cast("bigint").alias("size"),
    )


def route(lines: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``target``: the last but one dot part of the spool entry's name, or ``unknown``."""
    word = F.regexp_extract(path, SPOOL_PATTERN, 1)
    return lines.withColumn("target", F.when(word.isin(*TARGETS), word).otherwise(F.lit("unknown")))


def read_spool(spark: SparkSession, spool: str) -> DataFrame:
    """(path, line, target) of everything in the spool."""
    lines = spark.read.option("recursiveFileLookup", "true").text(spool)
    return route(lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))


def judge(routed: DataFrame, column: str = "line") -> DataFrame:
    """Adds ``valid``: whether the line has the form of its target; null for no known target."""
    return routed.withColumn(
        "valid",
        F.when(F.col("target") == "message", audit.valid_message(column)).when(
            F.col("target") == "catalog", audit.valid_catalog(column)
        ),
    )


def _parsed(judged: DataFrame, target: str, column: str) -> DataFrame:
    """Well-formed lines of a target as typed columns. A field that does not fit its type is null."""
    types = {f.name: f.dataType for f in schema_of(target).fields}
    fields = F.split(F.col(column), "\t")

    def one(i: int, name: str) -> Column:
        raw, kind = F.get(fields, i), types[name]
        if isinstance(kind, T.TimestampNTZType):
            raw = s.parse_stamp(raw)
        elif not isinstance(kind, T.StringType):
            raw = raw.try_cast(kind)
        return raw.alias(name)

    lines = judged.filter((F.col("target") == target) & F.col("valid"))
    return lines.select(F.col(column).alias("source_line"), *[one(i, n) for i, n in enumerate(TARGETS[target])])


def _fits(target: str) -> Column:
    """Every typed field got a value."""
    types = {f.name: f.dataType for f in schema_of(target).fields}
    typed = [n for n in TARGETS[target] if not isinstance(types[n], T.StringType)]
    return reduce(and_, [F.col(n).isNotNull() for n in typed])


def accepted(judged: DataFrame, target: str, column: str = "line") -> DataFrame:
    """Rows of the lines that have the right form and the right types."""
    return _parsed(judged, target, column).filter(_fits(target)).select(*TARGETS[target])


def rejected(judged: DataFrame, column: str = "line") -> DataFrame:
    """(line, reason) of all other lines: unknown target, wrong form, or a value that does not fit."""
    line = F.col(column).alias("line")
    parts = [judged.filter(~F.coalesce("valid", F.lit(False))).select(
        line, F.when(F.col("target").isin(*TARGETS), F.lit("format")).otherwise(F.lit("target")).alias("reason")
    )]
    for target in TARGETS:
        misfits = _parsed(judged, target, column).filter(~_fits(target))
        parts.append(misfits.select(F.col("source_line").alias("line"), F.lit("value").alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def load_upload(lines: DataFrame, target: str, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of lines for one target."""
    judged = judge(lines.select(column, F.lit(target).alias("target")), column)
    return accepted(judged, target, column), rejected(judged, column)
