"""Contents of rows of any type, and damage followed down to ranges and rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keepsake.operators import verify

NESTED = "id bigint, a array<string>, m map<string,array<timestamp_ntz>>, s struct<x:string,y:string>, b binary, d decimal(20,3), f double, t timestamp_ntz"
T = dt.datetime(2024, 1, 1, 0, 0, 0, 1)


def row(i=1, a=("x", "y"), m=None, s=("p", "q"), b=b"\x00", d=1, f=1.5, t=T):
    return i, list(a) if a is not None else None, {"k": [T]} if m is None else m, s, b, d, f, t


ROWS = [
    row(), row(a=("x,y",)), row(a=("x", "y", None)), row(a=(None, "x", "y")), row(a=None), row(a=()), row(a=("", "x", "y")), row(a=("1:x1:y",)),
    row(m={}), row(m={"k": [T + dt.timedelta(microseconds=1)]}), row(m={"k": None}), row(m={"k": [T], "l": [T]}), row(m={"k|l": [T]}),
    row(s=("p|q", "")), row(s=("p", None)), row(s=(None, "p")), row(s=None), row(s=("-", "q")), row(s=(None, "q")),
    row(b=b"\x00\x00"), row(b=None), row(d=None), row(f=None), row(f=float("nan")), row(t=T + dt.timedelta(microseconds=1)), row(t=None), row(i=None),
]


@pytest.mark.parametrize("portable", [False, True])
def test_no_two_rows_have_one_content(spark, portable):
    from decimal import Decimal

    rows = [tuple(Decimal(v) if k == 5 and v is not None else v for k, v in enumerate(r)) for r in ROWS]
    df = spark.createDataFrame(rows, NESTED)
    parts = verify.content_parts(df, df.columns, portable)
    assert df.select(F.concat_ws("-", *parts).alias("h")).distinct().count() == len(ROWS)
    assert len(parts) == (4 if portable else 1)


def test_map_order_is_no_difference(spark):
    one = spark.sql("select map('a', map(1, 'x', 2, 'y'), 'b', map(3, 'z')) as m")
    two = spark.sql("select map('b', map(3, 'z'), 'a', map(2, 'y', 1, 'x')) as m")
    for portable in (False, True):
        h = [df.select(F.concat_ws("-", *verify.content_parts(df, ["m"], portable))).first()[0] for df in (one, two)]
        assert h[0] == h[1]


@pytest.mark.parametrize("key,kind", [("k", "bigint"), ("k", "string"), ("k", "timestamp_ntz"), ("k", "date")])
def test_damage_is_located(spark, key, kind):
    base = spark.range(5000).select(F.col("id"), (F.col("id") * 3 % 97).alias("v"))
    made = {
        "bigint": F.col("id") * 7 - 900, "string": F.concat(F.lit("key"), F.col("id").cast("string")),
        "timestamp_ntz": F.timestamp_seconds(F.col("id") * 1000).cast("timestamp_ntz"), "date": F.date_from_unix_date(F.col("id").cast("int")),
    }[kind]
    df = base.withColumn("k", F.when(F.col("id") != 4999, made))
    bad = df.filter("id <> 17").withColumn("v", F.when(F.col("id") == 2500, -1).otherwise(F.col("v"))).unionByName(df.filter("id = 40"))
    low, high = verify.key_ranges(df, key)
    for leaves in (1, 64, 1000):
        sums = [verify.range_sums(x, key, ["v", "id"], low, high, leaves) for x in (df, bad, df.repartition(3))]
        assert verify.damaged_ranges(sums[0], sums[2], low, high, leaves, 4).count() == 0
        ranges = verify.damaged_ranges(sums[0], sums[1], low, high, leaves, 4)
        number = {r["id"]: r["n"] for r in df.select("id", verify.key_number(df, key).alias("n")).filter("id in (17, 40, 2500)").collect()}
        found = ranges.collect()
        assert 1 <= len(found) <= 3
        assert all(any(r["first_key"] <= n <= r["last_key"] for r in found) for n in number.values())
        rows = verify.damaged_rows(df, bad, key, ["v", "id"], ranges, low, high, leaves).join(df.select(F.col(key).alias("dk"), "id"), F.col("dk") == F.col(key))
        assert sorted((r["id"], r["problem"]) for r in rows.collect()) == [(17, "missing"), (40, "changed"), (2500, "changed")]


def test_damage_of_rows_without_key(spark):
    df = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    bad = spark.createDataFrame([(None, 9), (1, 2)], "k int, v int")
    sums = [verify.range_sums(x, "k", ["v"], 1, 1, 8) for x in (df, bad)]
    ranges = verify.damaged_ranges(*sums, 1, 1, 8, 2)
    assert [r["leaf"] for r in ranges.collect()] == [-1]
    assert [tuple(r) for r in verify.damaged_rows(df, bad, "k", ["v"], ranges, 1, 1, 8).collect()] == [(None, "changed")]
    empty = df.limit(0)
    assert verify.key_ranges(empty, "k") == (0, 0)
    assert verify.damaged_ranges(*[verify.range_sums(x, "k", ["v"], 0, 0) for x in (empty, empty)], 0, 0).count() == 0


def test_sample_with_repeated_and_missing_ids(spark):
    rows = [(i % 40, "FULL", "SUCCESS", "NO") for i in range(400)] + [(None, "FULL", "SUCCESS", "NO")] * 7
    df = spark.createDataFrame(rows, "id int, dumptype string, status string, verified string")
    for percent in (1, 10, 33, 50, 99, 100):
        assert verify.verify_sample(df, percent, "s").count() == verify.quota_of(407, percent)
    draws = df.select(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("draw"))
    plain = sorted(r["draw"] for r in draws.collect())
    for quota in (1, 7, 100, 407):
        for rest in (1, 50, 10_000):
            border, n = verify.cut_off(draws, quota, rest)
            assert border == plain[quota - 1] and n == quota - plain.index(border)
    assert [verify.quota_of(n, p) for n, p in ((2, 25), (6, 25), (10, 25), (0, 25))] == [1, 2, 3, 0]
