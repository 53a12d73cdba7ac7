"""Text extraction over schema scripts, tables of contents, access lists and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepsake.functions import scalars as s

# Patterns of the lines that are read.
ROLE_LINE_PATTERN = (
    r"^(ALTER\ .*PRIVILEGES\ FOR\ .*;|ALTER\ .*OWNER\ TO.*;|GRANT\ .*ON\ .*TO\ .*;|REVOKE\ .*ON\ .*FROM\ .*;)$"
)
TABLESPACE_LINE_PATTERN = r"^SET\ default_tablespace\ \=\ .*[^'];"
LOG_PROBLEM_PATTERN = r"WARNING|ERROR"
LOG_LINE_PATTERN = r"^(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"


def ddl_roles(ddl: DataFrame, by: str = "dump_id") -> DataFrame:
    """(by, role): roles a schema script grants to, revokes from or hands ownership to.

    The last word of the line counts, so of ``TO a, b`` only ``b`` is found. Words that
    contain "public" are dropped.
    """
    token = F.regexp_extract("line", r"(\S+).$", 1)
    return (
        ddl.filter(F.col("line").rlike(ROLE_LINE_PATTERN))
        .select(F.col(by), token.alias("token"))
        .filter(~F.col("token").rlike("(?i)public"))
        .select(F.col(by), F.regexp_replace("token", '"', "").alias("role"))
        .distinct()
    )


def ddl_tablespaces(ddl: DataFrame, by: str = "dump_id") -> DataFrame:
    """(by, tablespace): tablespaces a schema script switches to."""
    name = F.regexp_replace(F.get(F.split("line", r"\s+"), 3), r'[;"]', "")
    return ddl.filter(F.col("line").rlike(TABLESPACE_LINE_PATTERN)).select(F.col(by), name.alias("tablespace")).distinct()


def ddl_role_statements(ddl: DataFrame, role: str | None = None) -> DataFrame:
    """CREATE ROLE and ALTER ROLE lines with their ``role``; of one role if it is named."""
    name = F.regexp_extract("line", r'^(?:ALTER ROLE|CREATE ROLE) (?:"([^"]+)"|([^";\s]+))(?:;| )', 0)
    found = ddl.withColumn("head", name).filter(F.col("head") != "")
    rows = found.withColumn(
        "role", F.regexp_replace(F.regexp_replace("head", r'^(ALTER ROLE|CREATE ROLE) "?', ""), r'"?(;| )$', "")
    ).drop("head")
    return rows if role is None else rows.filter(F.col("role") == role)


def toc_schema_entries(toc: DataFrame, schema: str | None = None) -> DataFrame:
    """Lines that make a schema, its comment or its rights, with ``schema_name``; of one schema if named."""
    if schema is not None:
        marks = [f"SCHEMA - {schema} ", f"COMMENT - SCHEMA {schema} ", f"ACL - {schema} "]
        hit = F.contains(F.col("line"), F.lit(marks[0]))
        for m in marks[1:]:
            hit = hit | F.contains(F.col("line"), F.lit(m))
        return toc.filter(hit).withColumn("schema_name", F.lit(schema))
    name = F.regexp_extract("line", r"(?:COMMENT - SCHEMA|SCHEMA -|ACL -) (\S+) ", 1)
    return toc.withColumn("schema_name", name).filter(F.col("schema_name") != "")


def toc_flags(toc: DataFrame) -> DataFrame:
    """(dump_id, has_database, has_schema)."""
    def has(word: str):
        return F.bool_or(F.contains(F.col("line"), F.lit(word)))

    return toc.groupBy("dump_id").agg(has("DATABASE").alias("has_database"), has("SCHEMA").alias("has_schema"))


def toc_truncate(toc: DataFrame) -> DataFrame:
    """(dump_id, line_no, statement): a TRUNCATE for each table that has data in the dump."""
    words = F.split(F.trim("line"), r"\s+")
    text = F.concat(F.lit("TRUNCATE TABLE "), F.get(words, 5), F.lit("."), F.get(words, 6), F.lit(";"))
    return toc.filter(F.contains(F.col("line"), F.lit("TABLE DATA"))).select("dump_id", "line_no", text.alias("statement"))


def acl_explode(acl: DataFrame) -> DataFrame:
    """(datname, entry_no, acl_role, acl_rights) of every entry of the comma-separated access list."""
    items = acl.select("datname", F.posexplode(F.split("datacl", ",")).alias("pos", "acl"))
    return items.select(
        "datname", (F.col("pos") + 1).alias("entry_no"), s.split_part("acl", "=", 1).alias("acl_role"),
        s.regex_split("acl", "[=/]", 2).alias("acl_rights"),
    )


def acl_grants(acl: DataFrame) -> DataFrame:
    """(datname, statement_no, statement): the access list of each database as statements, in order.

    First all rights of public go, then each entry revokes and grants. The list of one
    database is one row, so nothing is shuffled.
    """
    db = F.col("datname")

    def per_entry(item):
        role = F.split_part(item, F.lit("="), F.lit(1))
        rights = F.get(F.split(item, "[=/]"), 1)
        who = F.when(role == "", F.lit("public")).otherwise(role)

        def grant(letter, word):
            return F.when(
                F.contains(rights, F.lit(letter)),
                F.concat(F.lit(f"GRANT {word} ON DATABASE "), db, F.lit(" TO "), who, F.lit(";")),
            )

        return F.array_compact(
            F.array(
                F.concat(F.lit("REVOKE ALL ON DATABASE "), db, F.lit(" FROM "), who, F.lit(";")),
                grant("C", "CREATE"), grant("T", "TEMP"), grant("c", "CONNECT"),
            )
        )

    first = F.array(F.concat(F.lit("REVOKE ALL ON DATABASE "), db, F.lit(" FROM public;")))
    rest = F.flatten(F.transform(F.split("datacl", ","), per_entry))
    return acl.filter(F.col("datacl").isNotNull()).select(
        "datname", F.posexplode(F.concat(first, rest)).alias("pos", "statement")
    ).select("datname", (F.col("pos") + 1).alias("statement_no"), "statement")


def acl_roles(acl: DataFrame) -> DataFrame:
    """Distinct roles named in any access list."""
    return acl_explode(acl).filter(F.col("acl_role") != "").select(F.col("acl_role").alias("role")).distinct()


def missing_tablespaces(ddl: DataFrame, existing: DataFrame) -> DataFrame:
    """(dump_id, tablespace) that the destination, ``existing(tablespace)``, does not have."""
    have = existing.select(F.col("tablespace").alias("have"))
    return ddl_tablespaces(ddl).join(have, F.col("tablespace") == F.col("have"), "left_anti")


def needed_roles(ddl: DataFrame, acl: DataFrame, owners: DataFrame, dumps: DataFrame) -> DataFrame:
    """(dump_id, role) that a restore of a dump needs: from its script, and from the access list and owner of its database.

    ``dumps(dump_id, dbname)``, ``owners(datname, role)``.
    """
    of_databases = acl_explode(acl).filter(F.col("acl_role") != "").select("datname", F.col("acl_role").alias("role")).union(
        owners.select("datname", "role")).distinct()
    by_database = dumps.join(of_databases, F.col("datname") == F.col("dbname")).select("dump_id", "role")
    return ddl_roles(ddl).select("dump_id", "role").union(by_database).distinct()


def missing_roles(ddl: DataFrame, acl: DataFrame, owners: DataFrame, dumps: DataFrame, existing: DataFrame) -> DataFrame:
    """(dump_id, role) of the needed roles that ``existing(role)`` lacks."""
    have = existing.select(F.col("role").alias("have"))
    return needed_roles(ddl, acl, owners, dumps).join(have, F.col("role") == F.col("have"), "left_anti")


def restore_preparation(restorejob: DataFrame, roles: DataFrame, spaces: DataFrame, there: DataFrame) -> DataFrame:
    """(restore_id, kind, name): what has to be made at a destination before a restore.

    ``roles(dump_id, role)`` and ``spaces(dump_id, tablespace)`` are what dumps need, ``there(
    pgsql_instance_id, kind, name)`` what instances have. Jobs that leave roles or tablespaces
    out need none of them.
    """
    jobs = restorejob.select(F.col("id").alias("restore_id"), "catalog_id", "dest_pgsql_instance_id", "role_handling", "tblspc_handling")
    wanted = roles.select("dump_id", F.lit("role").alias("kind"), F.col("role").alias("name")).union(
        spaces.select("dump_id", F.lit("tablespace").alias("kind"), F.col("tablespace").alias("name")))
    asked = ((F.col("kind") == "role") & (F.col("role_handling") == "USE_ROLE")) | (
        (F.col("kind") == "tablespace") & (F.col("tblspc_handling") == "USE_TBLSPC"))
    have = there.select(F.col("pgsql_instance_id").alias("h_instance"), F.col("kind").alias("h_kind"), F.col("name").alias("h_name"))
    rows = jobs.join(wanted, F.col("dump_id") == F.col("catalog_id")).filter(asked)
    return rows.join(
        have, (F.col("h_instance") == F.col("dest_pgsql_instance_id")) & (F.col("h_kind") == F.col("kind")) & (F.col("h_name") == F.col("name")), "left_anti"
    ).select("restore_id", "kind", "name")


def pipe_lookup(lines: DataFrame, keys: DataFrame, field: int, column: str = "line") -> DataFrame:
    """(key, value): field ``field`` of the ``|`` lines whose first field is one of ``keys(key)``."""
    first = F.when(F.contains(F.col(column), F.lit("|")), s.split_part(column, "|", 1))
    rows = lines.select(first.alias("first"), s.cut_field(column, "|", field).alias("value"))
    return rows.join(keys.select("key").distinct(), F.col("first") == F.col("key")).select("key", "value")


def log_parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """(logtime, level, tool, message) of ``stamp level tool message`` lines."""
    mark = "\u0001"
    # one match a line: a line of the right form comes out marked and in parts, any other as it is
    packed = F.regexp_replace(column, LOG_LINE_PATTERN, f"{mark}$1{mark}$2{mark}$3{mark}$4")
    parts = lines.select(F.col(column).alias("line"), packed.alias("packed")).filter(
        F.startswith("packed", F.lit(mark)) & (F.col("packed") != F.col("line"))).select(F.split("packed", mark, 5).alias("p"))
    return parts.select(
        s.parse_stamp(F.col("p")[1]).alias("logtime"), F.col("p")[2].alias("level"), F.col("p")[3].alias("tool"), F.col("p")[4].alias("message")
    )


def log_to_message(lines: DataFrame, worker, jobclass: str = "CACHE_CONFIG", column: str = "line") -> DataFrame:
    """Message rows of the log lines that tell of a warning or an error, words joined by one blank."""
    problems = lines.filter(F.col(column).rlike(LOG_PROBLEM_PATTERN)).select(
        F.trim(F.regexp_replace(column, r"\s+", " ")).alias("line")
    )
    return log_parse(problems).select(
        "logtime", "level", "tool", "message", F.lit(jobclass).alias("jobclass"), F.lit(-1).alias("jobid"),
        F.lit(str(worker)).alias("bu_worker_id"),
    )


def settings_row(databases: DataFrame, tablespaces: DataFrame) -> DataFrame:
    """One settings row per database.

    ``databases(datname, owner, encoding, datcollate, datctype, datacl, tablespace_id)``; the
    default tablespace is left out and ``C.`` locales become ``C``.
    """
    t = tablespaces.filter(F.col("spcname") != "pg_default").select(F.col("id").alias("t_id"), "spcname")

    def plain(c: str):
        return F.when(F.substring(c, 1, 2) == "C.", F.lit("C")).otherwise(F.col(c))

    return databases.join(t, F.col("t_id") == F.col("tablespace_id"), "left").select(
        "datname", "owner", "encoding", plain("datcollate").alias("collate"), plain("datctype").alias("ctype"),
        F.col("datacl").alias("acl_rights"), F.col("spcname").alias("dattablespace"),
    )
