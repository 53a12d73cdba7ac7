"""Self-check lines for the text operators."""

import random
import re

from pyspark.sql import functions as F

from keepsake.operators import audit, extract as x

# Own cases, made from the rule of each operator: near misses, quotes with blanks, several owners, empty lines.
TOC = [
    "", "1; 1 1 TABLE - archive clerk", "3; 1 2 SCHEMA - ledger clerk", "4; 1 3 SCHEMA - Ledger auditor", "9; 1 4 SCHEMA - archive clerk",
    "10; 0 0 COMMENT - SCHEMA archive clerk", "12; 0 0 ACL - ledger clerk", "SCHEMA without number",
]
ROLES = ['CREATE ROLE clerk;', 'CREATE ROLE "Clerk";', 'ALTER ROLE clerk WITH LOGIN;', 'CREATE ROLE clerks;', "-- CREATE ROLE clerk;", "", 'ALTER ROLE "Clerk" WITH NOLOGIN;']
RIGHTS = [
    "", "ALTER TABLE ledger.t OWNER TO auditor;", 'ALTER SCHEMA "two words" OWNER TO clerk;', "GRANT SELECT ON TABLE ledger.t TO reader;",
    "GRANT SELECT ON TABLE ledger.u TO PUBLIC;", "-- owner is nobody", "COMMENT ON TABLE t IS 'TO them';",
]
PIPES = ["7|a b|north", "8||empty", "9|a b", "70|c|south", "", "7|c|again"]


def lines(spark, texts, n=1):
    return spark.createDataFrame([(n, i, t) for i, t in enumerate(texts)], "dump_id int, line_no int, line string")


def test_toc(spark):
    toc = lines(spark, TOC)
    assert [x.toc_schema_entries(toc, n).count() for n in ("ledger", "Ledger", "archive", "clerk")] == [2, 1, 2, 0]
    assert {r["schema_name"] for r in x.toc_schema_entries(toc).collect()} == {"ledger", "Ledger", "archive"}
    flags = x.toc_flags(toc.union(lines(spark, ["5; 1 1 DATABASE - books clerk"], 2))).orderBy("dump_id").collect()
    assert [(r["has_database"], r["has_schema"]) for r in flags] == [(False, True), (True, False)]


def test_role_statements_match_case_and_quotes(spark):
    ddl = lines(spark, ROLES)
    assert [x.ddl_role_statements(ddl, r).count() for r in ("clerk", "Clerk", "clerks", "CLERK")] == [2, 2, 1, 0]
    assert x.ddl_role_statements(ddl).count() == 5


def test_ddl_roles_take_the_last_word(spark):
    assert {r["role"] for r in x.ddl_roles(lines(spark, RIGHTS)).collect()} == {"auditor", "clerk", "reader"}


def test_tablespaces(spark):
    ddl = lines(spark, ["SET default_tablespace = '';", "SET default_tablespace = archive2;", "SET default_tablespace", 'SET default_tablespace = "Cold Store";', ""])
    assert {r["tablespace"] for r in x.ddl_tablespaces(ddl).collect()} == {"archive2", "Cold"}


def test_pipe_lookup(spark):
    keys = spark.createDataFrame([("7",), ("8",), ("9",), ("9",)], "key string")
    got = x.pipe_lookup(lines(spark, PIPES), keys, 2).collect()
    assert sorted((r["key"], r["value"] or "") for r in got) == [("7", "a b"), ("7", "c"), ("8", ""), ("9", "a b")]


def test_upload_patterns(spark):
    good = "\t".join(["77", "20200229T000000+0000", "20200229T001500-0330", "FAILED", "n_1.x", "/srv/a-b/n_1.x", "-1", "0",
                      "books", "*", "SCHEMA", "two words", "", "8", "", "h", "1"])
    df = spark.createDataFrame([(good,), (good.replace("FAILED", "failed"),), (good.rpartition("\t")[0],), ("",), (None,)], "line string")
    assert [r["valid"] for r in audit.validate(df, "catalog").collect()] == [True, False, False, False, False]
    ok, bad = audit.accepted_rejected(df, "catalog")
    assert (ok.count(), bad.count()) == (1, 4)


def test_catalog_pattern_accepts_what_the_plain_one_does(spark):
    plain = re.compile(
        r"^\d+\t\d{8}T\d{6}[+-]\d+\t\d{8}T\d{6}[+-]\d+\t[A-Z]+\t[a-zA-Z0-9_\.\/-]+\t[a-zA-Z0-9_\.\/-]+\t-?\d+\t-?\d+"
        r"\t.*\t.*\t.*\t.*\t.*\t\d+\t.*\t.*\t\d+$")
    g, head, texts = random.Random(3), "4\t20240101T000000+0000\t20240101T000000+0000\tSUCCESS\tn\t/l\t1\t-1", []
    for _ in range(4000):
        tail = [g.choice(["", "x", "5", "93", "a b", "1x", "caf\u00e9\r"]) for _ in range(g.choice([8, 9, 9, 9, 9, 10, 11, 12]))]
        texts.append("\t".join([head, *tail]))
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = {r["line"]: r["valid"] for r in audit.validate(df, "catalog").collect()}
    want = {t: plain.match(t) is not None for t in texts}
    assert got == want and 100 < sum(want.values()) < len(want) - 100


def test_log_lines(spark):
    df = spark.createDataFrame([
        ("20240101T000000+0100 ERROR tool  two   blanks ",), ("20240101T000000+0000 INFO tool saw ERROR text",), ("20240101T000000+0000 INFO tool fine",), ("short",),
    ], "line string")
    rows = x.log_to_message(df, 4).collect()
    assert [(str(r["logtime"]), r["level"], r["message"], r["bu_worker_id"]) for r in rows] == [
        ("2023-12-31 23:00:00", "ERROR", "two blanks", "4"), ("2024-01-01 00:00:00", "INFO", "saw ERROR text", "4")]


def test_acl(spark):
    acl = spark.createDataFrame([(1, "d", "=Tc/postgres,bob=CTc/postgres"), (2, "e", None)], "db_id int, datname string, datacl string")
    got = [r["statement"] for r in x.acl_grants(acl).orderBy("statement_no").collect()]
    assert got == [
        "REVOKE ALL ON DATABASE d FROM public;", "REVOKE ALL ON DATABASE d FROM public;", "GRANT TEMP ON DATABASE d TO public;",
        "GRANT CONNECT ON DATABASE d TO public;", "REVOKE ALL ON DATABASE d FROM bob;", "GRANT CREATE ON DATABASE d TO bob;",
        "GRANT TEMP ON DATABASE d TO bob;", "GRANT CONNECT ON DATABASE d TO bob;"]
    assert [r["role"] for r in x.acl_roles(acl).collect()] == ["bob"]


def test_truncate(spark):
    toc = lines(spark, ["12; 0 84 TABLE DATA s1 t12 owner1", "13; 0 84 TABLE s1 t13 owner1"])
    assert [r["statement"] for r in x.toc_truncate(toc).select(F.col("statement")).collect()] == ["TRUNCATE TABLE s1.t12;"]
