"""Row validation and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keepsake.session import settle

# Line patterns of the upload formats. Only a line feed ends a line (?d).
# A catalog line may hold any text in nine of its fields. Where "anything, then a tab"
# repeats, all but one are written as "no tab, then a tab": that accepts the same lines
# and leaves the matcher few ways to try.
MESSAGE_PATTERN = (
    r"(?d)^\d{8}T\d{6}[+-]\d+\t((INFO|WARNING|ERROR|CRITICAL|DEBUG))\t.+\t.*\t"
    r"((CACHE_CONFIG|DUMP|RESTORE|VERIFY|DEDUP|CLEAN))\t-?\d+\t\d+$"
)
CATALOG_PATTERN = (
    r"(?d)^\d+\t\d{8}T\d{6}[+-]\d+\t\d{8}T\d{6}[+-]\d+\t[A-Z]+\t[a-zA-Z0-9_\.\/-]+\t[a-zA-Z0-9_\.\/-]+\t"
    r"-?\d+\t-?\d+\t(?:[^\t\n]*+\t){4}.*\t\d+\t[^\t\n]*+\t.*\t\d+$"
)

# Patterns of the table checks.
CRON_PATTERN = r"^([\*\/0-9,]+\ ){4}[\*\/0-9,]+$"
NAME_PATTERN = r'^[^".]*$'
ID_LIST_PATTERN = r"^[0-9,]*$"

# Allowed words per table and column.
ALLOWED: dict[str, dict[str, list[str]]] = {
    "catalog": {
        "keep": ["NO", "YES", "AUTO"],
        "status": ["SUCCESS", "FAILED", "REMOVING"],
        "verified": ["YES", "FAILED", "NO"],
    },
    "worker": {"status": ["ACTIVE", "HALTED"]},
    "dumpjob": {
        "dumptype": ["FULL", "SCHEMA", "CLUSTER_SCHEMA", "SCRIPT", "CLUSTER"],
        "jobtype": ["REPEAT", "SINGLE"],
        "status": ["ACTIVE", "HALTED"],
    },
    "restorejob": {
        "existing_db": ["DROP", "RENAME", "DROP_BEFORE", "LEAVE", "TRUNCATE"],
        "jobtype": ["SINGLE", "REPEAT", "TRIGGER"],
        "restoretype": ["FULL", "DATA", "SCHEMA"],
        "status": ["ACTIVE", "HALTED"],
    },
    "instance": {"def_jobstatus": ["INHERIT", "HALTED", "ACTIVE"], "status": ["ACTIVE", "HALTED"]},
}

# Pattern checks per table and column.
PATTERNS: dict[str, dict[str, str]] = {
    "worker": {
        "cron_cacheconfig": CRON_PATTERN, "cron_clean": CRON_PATTERN,
        "cron_singlejob": CRON_PATTERN, "cron_upload": CRON_PATTERN,
    },
    "dumpjob": {
        "cron": CRON_PATTERN, "dbname": NAME_PATTERN, "dumpschema": NAME_PATTERN,
        "restorejob_id": ID_LIST_PATTERN,
    },
    "restorejob": {"cron": CRON_PATTERN, "dest_dbname": NAME_PATTERN, "restoreschema": NAME_PATTERN},
}

# Fixed values: (table, column, parent table) of the foreign keys.
FOREIGN_KEYS = [
    ("catalog", "bu_worker_id", "worker"),
    ("dumpjob", "pgsql_instance_id", "instance"),
    ("dumpjob", "worker_id", "worker"),
    ("instance", "worker_id_default", "worker"),
    ("restorejob", "dest_pgsql_instance_id", "instance"),
    ("restorejob", "catalog_id", "catalog"),
    ("restorelog", "restorejob_id", "restorejob"),
]

# Unique keys besides each table's id.
UNIQUE_KEYS = {
    "worker": [["dns_name"]],
    "instance": [["dns_name", "pgport"]],
    "setting": [["key"]],
    "script": [["scriptname"]],
    "metainfo": [["key"]],
}


def valid_message(line: Column | str) -> Column:
    return (F.col(line) if isinstance(line, str) else line).rlike(MESSAGE_PATTERN)


def valid_catalog(line: Column | str) -> Column:
    return (F.col(line) if isinstance(line, str) else line).rlike(CATALOG_PATTERN)


def validate(lines: DataFrame, target: str, column: str = "line") -> DataFrame:
    """Each line with a ``valid`` flag, judged on its own."""
    rule = {"message": valid_message, "catalog": valid_catalog}[target]
    return lines.withColumn("valid", F.coalesce(rule(column), F.lit(False)))


def accepted_rejected(lines: DataFrame, target: str, column: str = "line") -> tuple[DataFrame, DataFrame]:
    marked = validate(lines, target, column)
    return marked.filter("valid").drop("valid"), marked.filter("not valid").drop("valid")


def table_rules(table: str) -> dict[str, Column]:
    """Named conditions that every row of the table has to meet; null counts as met."""
    rules = {f"{table}_{c}_check": F.col(c).isin(words) for c, words in ALLOWED.get(table, {}).items()}
    rules.update({f"{table}_{c}_check": F.col(c).rlike(p) for c, p in PATTERNS.get(table, {}).items()})
    return rules


def check_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id, rule) for every broken rule; one pass per table."""

    def one(table: str, df: DataFrame) -> DataFrame:
        broken = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in table_rules(table).items()]))
        return df.select(F.lit(table).alias("table_name"), F.col("id").cast("bigint").alias("id"),
                         F.explode(broken).alias("rule"))

    return reduce(DataFrame.unionByName, [one(t, df) for t, df in tables.items()])


def references(tables: dict[str, DataFrame], keys=FOREIGN_KEYS) -> DataFrame:
    """(table_name, key_column, parent, id, value) of every reference that is not null: one pass over each child."""
    parts = []
    for child in dict.fromkeys(t for t, _, _ in keys):
        own = F.array(*[
            F.struct(F.lit(c).alias("key_column"), F.lit(p).alias("parent"), F.col(c).cast("bigint").alias("value")) for t, c, p in keys if t == child])
        rows = tables[child].select(F.lit(child).alias("table_name"), F.col("id").cast("bigint").alias("id"), F.explode(own).alias("r"))
        parts.append(rows.select("table_name", "r.key_column", "r.parent", "id", "r.value").filter(F.col("value").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def fk_audit(tables: dict[str, DataFrame], keys=FOREIGN_KEYS) -> DataFrame:
    """(table_name, key_column, id, value) of every dangling reference.

    The distinct values of all keys are held against the ids of all parents at once, each child
    and each parent read one time, and what is missing is written down. The references are then
    matched against that only, and as there is little as a rule, without a shuffle; a key value
    that fills a third of a child never moves as a group.
    """
    refs = references(tables, keys)
    parents = reduce(DataFrame.unionByName, [
        tables[p].select(F.lit(p).alias("p_name"), F.col("id").cast("bigint").alias("p_id")) for p in dict.fromkeys(p for _, _, p in keys)])
    missing = settle(
        refs.select("parent", "value").distinct().join(parents, (F.col("p_name") == F.col("parent")) & (F.col("p_id") == F.col("value")), "left_anti"),
        "missing-parents",
    ).select(F.col("parent").alias("m_parent"), F.col("value").alias("m_value"))
    return refs.join(missing, (F.col("m_parent") == F.col("parent")) & (F.col("m_value") == F.col("value")), "left_semi").select(
        "table_name", "key_column", "id", "value")


def unique_audit(tables: dict[str, DataFrame], keys=UNIQUE_KEYS) -> DataFrame:
    """(table_name, key_columns, key_value, row_count) of every value that occurs twice or more.

    A key with a null part is never a duplicate.
    """
    parts = []
    for table, df in tables.items():
        for columns in ([["id"]] if "id" in df.columns else []) + keys.get(table, []):
            value = F.concat(*[F.concat(F.lit("|" if i else ""), F.col(c).cast("string")) for i, c in enumerate(columns)])
            parts.append(
                df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))
                .filter((F.col("row_count") > 1) & value.isNotNull())
                .select(F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"),
                        value.alias("key_value"), "row_count")
            )
    return reduce(DataFrame.unionByName, parts)


def delete_cascade(
    restorejob: DataFrame, restorelog: DataFrame, ids: DataFrame, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the jobs in ``ids`` and without the log rows of those jobs."""
    gone = ids.select(F.col(key).alias("gone_id"))
    jobs = restorejob.join(gone, F.col("id") == F.col("gone_id"), "left_anti")
    logs = restorelog.join(gone, F.col("restorejob_id") == F.col("gone_id"), "left_anti")
    return jobs, logs
