"""Row filters and lists.

Filters return a condition, so several of them combine with AND and the optimizer
moves them to the scan. A list is ``list_rows(view, [conditions], sort, limit)``.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from keepsake.functions import scalars as s

# The time column behind the hour filter of each list.
HOUR_COLUMNS = {
    "catalog": "starttime", "restorelog": "starttime", "message": "logtime", "activity": "starttime",
    "dumpjob": "date_added", "restorejob": "date_added", "worker": "date_added", "instance": "date_added",
    "database": "date_added", "copyjob": "date_added",
}

# The status column of the lists that have a status filter.
STATUS_COLUMNS = {
    "instance": "status", "worker": "status", "dumpjob": "status", "restorejob": "status", "copyjob": "dstatus",
}

# Lists whose schedule can be filtered.
SCHEDULE_LISTS = ("dumpjob", "restorejob", "copyjob")


class UnknownFilter(ValueError):
    """The filter is not defined for this list."""


def within_hours(table: str, now, hours: float = 24) -> Column:
    """On the base table (not the formatted view): younger than ``hours`` at ``now``."""
    if table not in HOUR_COLUMNS:
        raise UnknownFilter(f"hour filter on {table}")
    return s.age_filter(HOUR_COLUMNS[table], now, hours)


def by_jobid(table: str, job: int | str) -> Column:
    """On the list itself. ``base_conditions`` says the same on the tables it is made from."""
    if table in ("dumpjob", "restorejob"):
        return F.col("id") == F.lit(job).cast("int")
    if table in ("catalog", "restorelog"):
        return s.split_part("id_db_schema", "/", 1).like(str(job))
    if table == "copyjob":
        return F.col("did") == F.lit(job).cast("int")
    raise UnknownFilter(f"job filter on {table}")


def by_database(table: str, name: str) -> Column:
    """``name`` may hold LIKE wildcards except for restore and copy jobs, which compare exactly."""
    if table in ("catalog", "restorelog"):
        return s.split_part("id_db_schema", "/", 2).like(f"{name}.%")
    if table in ("dumpjob", "database"):
        return F.col("dbname").like(name)
    if table == "restorejob":
        return (s.split_part("s_db_schema", ".", 1) == name) | (F.col("d_dbname") == name)
    if table == "copyjob":
        return (s.split_part("s_db_schema", ".", 1) == name) | (s.split_part("d_db_schema", ".", 1) == name)
    raise UnknownFilter(f"database filter on {table}")


# Base columns that the text ``id/db.schema`` of a list is built from.
ID_DB_SCHEMA = {"catalog": ("dumpjob_id", "dbname", "dumpschema"), "restorelog": ("restorejob_id", "dest_dbname", "restoreschema")}


def _plain_start(pattern: str) -> str:
    """What every text that is LIKE a pattern begins with."""
    return re.split(r"[%_\\]", pattern, maxsplit=1)[0]


def _built(table: str) -> Column:
    """None of the parts of ``id/db.schema`` is null, and neither is the text."""
    return reduce(and_, [F.col(c).isNotNull() for c in ID_DB_SCHEMA[table]])


def base_conditions(table: str, kind: str, value: int | str) -> dict[str, Column]:
    """A ``jobid``, ``database`` or ``schedule`` filter of a list as conditions on its base tables.

    The list over the filtered tables has the rows of the filtered list, and the conditions reach
    the scans: texts that lists build from columns are taken apart, and what a pattern says
    about a column by itself is said about it.
    """
    if kind == "jobid":
        if table in ("dumpjob", "restorejob"):
            return {table: by_jobid(table, value)}
        if table == "copyjob":
            return {"dumpjob": F.col("id") == F.lit(value).cast("int")}
        if table in ID_DB_SCHEMA:
            number = ID_DB_SCHEMA[table][0]
            text = str(value)
            if re.fullmatch(r"0|-?[1-9][0-9]{0,8}", text):
                return {table: (F.col(number) == int(text)) & _built(table)}
            return {table: F.col(number).cast("string").like(text) & _built(table)}
    if kind == "database":
        if table in ID_DB_SCHEMA:
            number, db, schema = ID_DB_SCHEMA[table]
            # the text after the first slash, up to the next one
            whole = s.split_part(s.concat_null(db, F.lit("."), schema), "/", 1).like(f"{value}.%")
            start = _plain_start(str(value))
            exact = whole & _built(table)
            return {table: exact & F.startswith(F.col(db), F.lit(start)) if start and "." not in start and "/" not in start else exact}
        if table in ("dumpjob", "database"):
            return {"dumpjob": F.col("dbname").like(value)}
    if kind == "schedule" and table in SCHEDULE_LISTS:
        letter = value[:1].upper()
        begins = F.startswith(F.col("jobtype"), F.lit(letter)) if letter else F.lit(False)
        labelled = F.col("cron").isNotNull() | (F.col("jobtype") == "TRIGGER") if table == "restorejob" else F.col("cron").isNotNull()
        return {"restorejob" if table == "restorejob" else "dumpjob": begins & labelled}
    raise UnknownFilter(f"{kind} filter on {table}")


def restores_of_database(restorejob: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """The restore jobs that read from or write to a database: two conditions, each where its column is."""
    start = [F.startswith("dbname", F.lit(name))] if "." not in name else []
    reads = catalog.filter(reduce(and_, [s.split_part(s.db_schema("dbname", "dumpschema"), ".", 1) == name, *start])).select(F.col("id").alias("c_id"))
    ids = restorejob.filter(F.col("dest_dbname") == name).select(F.col("id").alias("r_id")).union(
        restorejob.join(reads, F.col("c_id") == F.col("catalog_id"), "left_semi").select("id")).distinct()
    return restorejob.join(ids, F.col("r_id") == F.col("id"), "left_semi")


def by_schedule(table: str, word: str) -> Column:
    if table not in SCHEDULE_LISTS:
        raise UnknownFilter(f"schedule filter on {table}")
    return s.cut_text("schedule", 1) == word[:1].upper()


def by_status(table: str, word: str) -> Column:
    if table not in STATUS_COLUMNS:
        raise UnknownFilter(f"status filter on {table}")
    return s.cut_text(STATUS_COLUMNS[table], 1) == word[:1].upper()


def free(text: str) -> Column:
    """A Spark SQL condition on any column of the list; with a ``;`` in it, it filters nothing."""
    return F.lit(True) if ";" in text else F.expr(text)


def list_rows(
    view: DataFrame, conditions: list[Column] | None = None, sort: str | None = None,
    limit: int | None = None, key: str = "id",
) -> DataFrame:
    """Rows of a view under all conditions; ``sort`` is 'asc', 'desc' or None for the view's own order."""
    if conditions:
        view = view.filter(reduce(and_, conditions))
    if sort == "asc":
        view = view.orderBy(F.col(key).asc_nulls_last())
    elif sort == "desc":
        view = view.orderBy(F.col(key).desc_nulls_first())
    elif sort is not None:
        raise ValueError("sort is 'asc', 'desc' or None")
    return view if limit is None else view.limit(limit)


def details(table: DataFrame, key_value, key: str = "id") -> DataFrame:
    """One row as (position, name, value) lines; nulls print as ``None``."""
    names = table.columns
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(n).alias("name"),
                s.null_default(F.col(n).cast("string"), "None").alias("value"),
            )
            for i, n in enumerate(names, 1)
        ]
    )
    return table.filter(F.col(key) == key_value).select(F.inline(lines))
