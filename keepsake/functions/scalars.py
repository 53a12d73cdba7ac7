"""Column expressions (F1-F27). All are built-in Spark expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Text forms of times.
STAMP_FORMAT = "yyyyMMdd'T'HHmmss"
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"
TWO_LINE_FORMAT = "yyyy-MM-dd\nHH:mm:ss"

# Fixed value: file ending of whole-cluster dumps, as a pattern.
EXTENSION_PATTERN = r".sql.gz$"

# Fixed value: names that need no quotes.
PLAIN_NAME_PATTERN = r"^[\*_0-9a-z]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(value: dt.datetime | str | Column) -> Column:
    """An explicit "now" as a zone-free timestamp."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def concat_null(*parts: Column | str) -> Column:
    """Text concatenation that is null as soon as one part is null."""
    return F.concat(*[col(p).cast("string") for p in parts])


def cut_text(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def fmt_time(c: Column | str, form: str = SECOND_FORMAT) -> Column:
    return F.date_format(col(c), form)


def duration(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end; null while one is missing."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def age_filter(c: Column | str, now, hours: float) -> Column:
    """True when the age of ``c`` at ``now`` is below ``hours`` (may be fractional).

    Written as a comparison of the bare column with a constant, so it reaches the scan.
    """
    return col(c) > moment(now) - F.make_dt_interval(secs=F.lit(float(hours) * 3600.0).cast("decimal(18,6)"))


def split_part(c: Column | str, sep: str, n: int) -> Column:
    return F.split_part(col(c), F.lit(sep), F.lit(n))


def cut_field(c: Column | str, sep: str, n: int) -> Column:
    """Field ``n`` of a separated line; a line without the separator comes back whole."""
    return F.when(~F.contains(col(c), F.lit(sep)), col(c)).otherwise(split_part(c, sep, n))


def regex_split(c: Column | str, pattern: str, n: int) -> Column:
    """Element ``n`` (from 1) after splitting on a pattern; null if there is none."""
    return F.get(F.split(col(c), pattern), n - 1)


def id_list(c: Column | str) -> Column:
    """Comma text to an array of ints; null, '' and empty pieces give nothing."""
    pieces = F.filter(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.transform(pieces, lambda x: F.trim(x).cast("int"))


def null_default(c: Column | str, default) -> Column:
    return F.coalesce(col(c), default if isinstance(default, Column) else F.lit(default))


def lower_key(c: Column | str) -> Column:
    return F.lower(col(c))


def schedule_label(jobtype: Column | str, cron: Column | str) -> Column:
    """``TRIGGER`` as it is, else first letter of the job type, ``/`` and the schedule."""
    return F.when(col(jobtype) == "TRIGGER", col(jobtype)).otherwise(
        concat_null(cut_text(jobtype, 1), F.lit("/"), cron)
    )


def quote_ident(c: Column | str) -> Column:
    return F.when(col(c).rlike(PLAIN_NAME_PATTERN), col(c)).otherwise(
        concat_null(F.lit('"'), c, F.lit('"'))
    )


def strip_quotes(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit('"'))


def version_code(c: Column | str) -> Column:
    """``9.6.1`` to ``96``, ``10.3`` to ``10``: two digits below major version 10."""
    major = cut_field(c, ".", 1)
    return F.when(major.cast("int") < 10, F.concat(major, cut_field(c, ".", 2))).otherwise(major)


def blank_to_null(c: Column | str) -> Column:
    return F.when(~col(c).rlike(r"^\s*$"), col(c))


def strip_extension(c: Column | str) -> Column:
    return F.regexp_replace(col(c), EXTENSION_PATTERN, "")


def blob_path(checksum: Column | str) -> Column:
    c = col(checksum)
    return F.concat_ws("/", F.substring(c, 1, 1), F.substring(c, 2, 1), c)


def checksum(c: Column | str, bits: int | None = None) -> Column:
    """md5 as hex text; ``bits`` asks for sha2 of that size instead."""
    return F.md5(col(c)) if bits is None else F.sha2(col(c), bits)


def window_length(start_hour: Column | str, end_hour: Column | str) -> Column:
    """Minutes from the start hour to the end hour of the next day, below one day."""
    return F.pmod(col(end_hour) - col(start_hour) + F.lit(24), F.lit(24)) * F.lit(60)


def seeded_int(seed: Column | str, below: Column) -> Column:
    """Repeatable number in 0..below-1 from the md5 of ``seed``."""
    return F.conv(F.substring(F.md5(col(seed).cast("string")), 1, 8), 16, 10).cast("bigint") % below


def random_cron(seed: Column | str, start_hour: Column | str, end_hour: Column | str) -> Column:
    """Daily schedule at a seeded minute of the backup window, both ends included."""
    offset = seeded_int(seed, window_length(start_hour, end_hour) + 1)
    minute = (col(start_hour) * 60 + offset) % F.lit(1440)
    return F.concat(
        (minute % 60).cast("int").cast("string"), F.lit(" "),
        F.floor(minute / 60).cast("int").cast("string"), F.lit(" * * *"),
    )


def numeric_round(c: Column | str) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.round(col(c).cast("decimal(38,10)"), 0).cast("bigint")


def percent_text(part: Column | str, whole: Column | str) -> Column:
    """``part`` as percent of ``whole`` without decimals, exact ties to even; null for whole = 0."""
    share = F.try_divide(col(part).cast("double"), col(whole).cast("double")) * 100
    return F.bround(share, 0).cast("bigint").cast("string")


def overlap_instant(start: Column | str, end: Column | str, t: Column | str) -> Column:
    return (col(start) <= col(t)) & (col(t) < col(end))


def compact_stamp(c: Column | str, zone: str = "+0000") -> Column:
    return F.concat(F.date_format(col(c), STAMP_FORMAT), F.lit(zone))


def parse_stamp(c: Column | str) -> Column:
    """``20240105T101500+0100`` to the zone-free UTC time; null if it is no such time."""
    iso = F.regexp_replace(
        col(c),
        r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})([+-]\d{2})(\d{2})$",
        "$1-$2-$3T$4:$5:$6$7:$8",
    )
    return F.when(col(c).rlike(r"^\d{8}T\d{6}[+-]\d{4}$"), iso.try_cast("timestamp_ltz")).cast("timestamp_ntz")


def like_match(c: Column | str, pattern: str) -> Column:
    return col(c).like(pattern)


def snapshot_name(job, db, schema, dumptype, stamp) -> Column:
    """``<job>_<db>[.<schema>]_<type>_<stamp>``; no schema part for ``*`` or scripts."""
    part = F.when((col(schema) == "*") | (col(dumptype) == "SCRIPT"), F.lit("")).otherwise(
        F.concat(F.lit("."), col(schema))
    )
    return concat_null(job, F.lit("_"), F.concat(col(db), part), F.lit("_"), dumptype, F.lit("_"), stamp)


def full_path(location: Column | str, name: Column | str) -> Column:
    return concat_null(location, F.lit("/"), name)


def host_port(host: Column | str, port: Column | str, sep: str = ":") -> Column:
    return concat_null(host, F.lit(sep), port)


def db_schema(db: Column | str, schema: Column | str) -> Column:
    return concat_null(db, F.lit("."), schema)
