"""Column functions on edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keepsake.functions import scalars as s


def value(spark, column, **fields):
    names = list(fields) or ["x"]
    types = {str: "string", int: "int", float: "double", dt.datetime: "timestamp_ntz"}
    row = tuple(v[0] if isinstance(v, tuple) else v for v in fields.values()) or (1,)
    ddl = ", ".join(f"{n} {(v[1] if isinstance(v, tuple) else types[type(v)])}" for n, v in (fields or {"x": 1}).items())
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("text,want", [("9.6.1", "96"), ("10.3", "10"), ("9.3", "93"), ("14", "14"), ("9", "99")])
def test_version_code(spark, text, want):
    assert value(spark, s.version_code("x"), x=text) == want


@pytest.mark.parametrize("text,want", [
    ("20240105T101500+0000", dt.datetime(2024, 1, 5, 10, 15)),
    ("20240105T101500+0130", dt.datetime(2024, 1, 5, 8, 45)),
    ("20240105T001500+0100", dt.datetime(2024, 1, 4, 23, 15)),
    ("20241305T101500+0000", None), ("garbage", None),
])
def test_parse_stamp(spark, text, want):
    assert value(spark, s.parse_stamp("x"), x=text) == want


def test_concat_null(spark):
    assert value(spark, s.concat_null("x", F.lit("/"), "y"), x="a", y=(None, "string")) is None


@pytest.mark.parametrize("text,want", [(None, []), ("", []), ("5", [5]), ("5,7", [5, 7]), ("5,,7,", [5, 7])])
def test_id_list(spark, text, want):
    assert value(spark, s.id_list("x"), x=(text, "string")) == want


@pytest.mark.parametrize("text,want", [("public", "public"), ("*", "*"), ("Sales", '"Sales"'), ("a b", '"a b"')])
def test_quote_ident(spark, text, want):
    assert value(spark, s.quote_ident("x"), x=text) == want


@pytest.mark.parametrize("text,want", [("", None), ("  ", None), ("\t", None), ("a ", "a ")])
def test_blank_to_null(spark, text, want):
    assert value(spark, s.blank_to_null("x"), x=text) == want


@pytest.mark.parametrize("start,end,want", [(2, 6, 240), (22, 4, 360), (5, 5, 0), (0, 23, 1380)])
def test_window_length(spark, start, end, want):
    assert value(spark, s.window_length("a", "b"), a=start, b=end) == want


def test_random_cron_stays_in_window(spark):
    rows = spark.range(500).select(s.random_cron("id", F.lit(22), F.lit(2)).alias("c")).collect()
    hours = {int(r[0].split()[1]) for r in rows}
    assert hours <= {22, 23, 0, 1, 2} and len({r[0] for r in rows}) > 50
    assert all(int(r[0].split()[0]) == 0 for r in rows if r[0].split()[1] == "2")


@pytest.mark.parametrize("part,whole,want", [(1.0, 8.0, "12"), (3.0, 8.0, "38"), (1.0, 3.0, "33"), (1.0, 0.0, None)])
def test_percent_text_ties_to_even(spark, part, whole, want):
    assert value(spark, s.percent_text("a", "b"), a=part, b=whole) == want


@pytest.mark.parametrize("x,want", [("2.5", 3), ("-2.5", -3), ("0.49", 0)])
def test_numeric_round(spark, x, want):
    assert value(spark, s.numeric_round("x"), x=x) == want


@pytest.mark.parametrize("line,n,want", [("a|b|c", 2, "b"), ("a|b", 5, ""), ("whole", 3, "whole")])
def test_cut_field(spark, line, n, want):
    assert value(spark, s.cut_field("x", "|", n), x=line) == want


def test_snapshot_name(spark):
    assert value(spark, s.snapshot_name(F.lit(4), F.lit("db"), "x", F.lit("FULL"), F.lit("t")), x="*") == "4_db_FULL_t"
    assert value(spark, s.snapshot_name(F.lit(4), F.lit("db"), "x", F.lit("FULL"), F.lit("t")), x="s") == "4_db.s_FULL_t"
    assert value(spark, s.snapshot_name(F.lit(4), F.lit("db"), "x", F.lit("SCRIPT"), F.lit("t")), x="s") == "4_db_SCRIPT_t"


def test_age_filter_takes_parts_of_hours(spark):
    now = "2024-01-02 00:00:00"
    t = dt.datetime(2024, 1, 1, 22, 31)
    assert value(spark, s.age_filter("x", now, 1.5), x=t) is True
    assert value(spark, s.age_filter("x", now, 1.48), x=t) is False


def test_strip_quotes_and_extension(spark):
    assert value(spark, s.strip_quotes("x"), x='"Mies"') == "Mies"
    assert value(spark, s.strip_extension("x"), x="a/b.sql.gz") == "a/b"
    assert value(spark, s.strip_extension("x"), x="a.sql.gz/b") == "a.sql.gz/b"
