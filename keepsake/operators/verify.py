"""Verification by sample."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from keepsake.functions import scalars as s
from keepsake.session import settle

# Fixed value: share of the open dumps that one run checks.
DEFAULT_PERCENT = 25
# Rows that are ranked one by one at the border of a sample.
RANKED_REST = 10_000
# Key ranges of a table, and how many of them a node of their tree has below it.
RANGES, FANOUT = 4096, 16


def verify_candidates(catalog: DataFrame) -> DataFrame:
    """Dumps still to be verified; a null type or null flag is not one of them."""
    return catalog.filter(
        ~F.col("dumptype").like("CLUSTER%") & (F.col("status") == "SUCCESS") & ~F.col("verified").like("YES")
    )


def quota_of(count: int, percent: int) -> int:
    """``count * percent / 100``, half rounded away from zero."""
    return int((Decimal(count) * percent / 100).quantize(Decimal(1), ROUND_HALF_UP))


def cut_off(draws: DataFrame, quota: int, rest: int = RANKED_REST) -> tuple[str, int]:
    """The quota-th smallest ``draw`` of a table, and how many of the rows with exactly this one are within the quota.

    Selection by digits: the counts of the next three hex digits (4096 rows at most) tell in which
    of them the wanted row is; only those with these digits are looked at again. When ``rest`` rows
    or fewer are left they are ranked; equal draws are counted together.
    """
    known, before, left = "", 0, draws
    while len(known) < 30:
        digits = F.substring("draw", len(known) + 1, 3)
        counts = left.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts):
            if before + r["n"] >= quota:
                known, size = known + r["digits"], r["n"]
                break
            before += r["n"]
        left = draws.filter(F.col("draw").startswith(known))
        if size <= rest:
            break
    # at most ``rest`` rows, or the few draws that share thirty digits
    for r in sorted(left.groupBy("draw").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + r["n"] >= quota:
            return r["draw"], quota - before
        before += r["n"]
    raise ValueError("quota beyond the table")


def verify_sample(catalog: DataFrame, percent: int = DEFAULT_PERCENT, seed: str = "0") -> DataFrame:
    """The exact first ``round(count * percent / 100)`` candidates in seeded random order.

    The order is the md5 of id and seed. One scan writes the draws; the one at the border is
    selected among these by counts of digits, so what is ranked is bounded at any size. A second
    scan takes all candidates up to it. Rows that repeat the id at the border are taken up to the quota.
    """
    draw = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed)))
    candidates = verify_candidates(catalog)
    draws = settle(candidates.select(draw.alias("draw")), "draws")
    quota = quota_of(draws.count(), percent)
    if quota == 0:
        return candidates.limit(0)
    border, of_border = cut_off(draws, quota)
    if draws.filter(F.col("draw") == border).count() == of_border:
        return candidates.filter(draw <= border)
    return candidates.filter(draw < border).unionByName(candidates.filter(draw == border).limit(of_border))


def encoded(value: Column, kind: T.DataType) -> Column:
    """A value as text that no other value of its type has: lengths in front, null as ``-``, maps in the order of their keys."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: encoded(x, kind.elementType))
        text = F.concat(F.lit("["), F.size(value).cast("string"), F.lit(":"), F.array_join(items, ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        items = F.array_sort(F.transform(F.map_entries(value), lambda e: F.concat(encoded(e["key"], kind.keyType), encoded(e["value"], kind.valueType))))
        text = F.concat(F.lit("{"), F.size(value).cast("string"), F.lit(":"), F.array_join(items, ""), F.lit("}"))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("("), *[encoded(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(")"))
    else:
        if isinstance(kind, T.BinaryType):
            plain = F.hex(value)
        elif isinstance(kind, T.TimestampType):
            plain = F.unix_micros(value).cast("string")
        else:
            plain = value.cast("string")
        text = F.concat(F.char_length(plain).cast("string"), F.lit(":"), plain)
    return F.when(value.isNull(), F.lit("-")).otherwise(text)


def content_parts(df: DataFrame, columns: list[str], portable: bool = False) -> list[Column]:
    """Numbers of a row whose sums are the order-free content of many rows.

    One 64-bit hash over typed values, nested ones in their encoded form; nulls are flagged, as the
    hash skips them. ``portable`` takes all 128 bits of the md5 over the encoded row, in four
    numbers, which other engines compute too.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    if portable:
        digest = F.md5(F.concat(*[encoded(F.col(c), kinds[c]) for c in columns]))
        return [F.conv(F.substring(digest, k, 8), 16, 10).cast("decimal(20,0)") for k in (1, 9, 17, 25)]
    values = [encoded(F.col(c), k) if isinstance(k, (T.MapType, T.ArrayType, T.StructType)) else F.col(c) for c, k in kinds.items()]
    return [F.xxhash64(*[x for c, v in zip(columns, values) for x in (F.col(c).isNull(), v)]).cast("decimal(20,0)")]


def content(parts: list[Column]) -> Column:
    """The content of a group of rows, as text; no rows have the content of zeros."""
    return F.concat_ws("-", *[F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts])


def fingerprint(df: DataFrame, key: str, columns: list[str], portable: bool = False) -> DataFrame:
    """(key, row_count, content) per snapshot: an order-free content checksum, combined before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), content(content_parts(df, columns, portable)).alias("content"))


def verify_snapshot(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, ok): does what was found equal the manifest? A missing side is a failure."""
    m = manifest.select(F.col(key).alias("m_key"), F.col("row_count").alias("m_rows"), F.col("content").alias("m_content"))
    f = found.select(F.col(key).alias("f_key"), F.col("row_count").alias("f_rows"), F.col("content").alias("f_content"))
    return m.join(f, F.col("m_key").eqNullSafe(F.col("f_key")), "full").select(
        F.coalesce("m_key", "f_key").alias(key),
        F.coalesce((F.col("m_rows") == F.col("f_rows")) & (F.col("m_content") == F.col("f_content")), F.lit(False)).alias("ok"),
    )


def key_number(df: DataFrame, key: str) -> Column:
    """A key as a whole number that keeps its order where it is a number or a time; other keys by their hash."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(key).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(key).cast("timestamp_ltz"))
    return F.conv(F.substring(F.md5(encoded(F.col(key), kind)), 1, 15), 16, 10).cast("bigint")


def key_ranges(df: DataFrame, key: str) -> tuple[int, int]:
    """Smallest and largest key number of a table, from one pass."""
    number = key_number(df, key)
    low, high = df.agg(F.min(number), F.max(number)).first()
    return (0, 0) if low is None else (low, high)


def leaf_of(df: DataFrame, key: str, low: int, high: int, leaves: int) -> Column:
    """Which of the even ranges of the key a row is in. Keys outside ``low`` to ``high`` belong to the end there, null keys to -1."""
    at = F.least(F.greatest(key_number(df, key), F.lit(low)), F.lit(high)).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    leaf = F.floor(at * F.lit(leaves) / F.lit(high - low + 1).cast("decimal(20,0)")).cast("bigint")
    return F.when(F.col(key).isNull(), F.lit(-1).cast("bigint")).otherwise(leaf)


def range_sums(df: DataFrame, key: str, columns: list[str], low: int, high: int, leaves: int = RANGES, portable: bool = False) -> DataFrame:
    """(leaf, row_count, part0, ...) of the even ranges of the key: the leaves of a tree whose nodes are sums of sums.

    One pass, combined before the shuffle.
    """
    sums = [F.sum(p).alias(f"part{i}") for i, p in enumerate(content_parts(df, columns, portable))]
    return df.groupBy(leaf_of(df, key, low, high, leaves).alias("leaf")).agg(F.count(F.lit(1)).alias("row_count"), *sums)


def damaged_ranges(expected: DataFrame, found: DataFrame, low: int, high: int, leaves: int = RANGES, fanout: int = FANOUT) -> DataFrame:
    """(leaf, first_key, last_key, row_count, found_count) of the ranges whose rows differ.

    From the whole down: a node whose sums agree is not opened. There are as many sums as leaves,
    whatever the size of the table; ``found`` is read once.
    """
    names = [c for c in expected.columns if c != "leaf"]
    m = expected.select(F.col("leaf").alias("m_leaf"), *[F.col(c).alias("m_" + c) for c in names])
    f = found.select(F.col("leaf").alias("f_leaf"), *[F.col(c).alias("f_" + c) for c in names])
    nodes = m.join(f, F.col("m_leaf") == F.col("f_leaf"), "full").select(
        F.coalesce("m_leaf", "f_leaf").alias("leaf"), *[F.coalesce(side + c, F.lit(0)).alias(side + c) for c in names for side in ("m_", "f_")])
    span = 1
    while span < leaves:
        span *= fanout
    while span:
        node = Window.partitionBy(F.floor(F.col("leaf") / span))
        differs = reduce(or_, [F.sum("m_" + c).over(node) != F.sum("f_" + c).over(node) for c in names])
        nodes = nodes.withColumn("differs", differs).filter("differs").drop("differs")
        span //= fanout
    size = F.lit(high - low + 1).cast("decimal(20,0)")
    edge = lambda leaf: F.ceil(leaf.cast("decimal(10,0)") * size / F.lit(leaves)).cast("bigint") + F.lit(low)
    known = F.col("leaf") >= 0
    return nodes.select(
        "leaf", F.when(known, edge(F.col("leaf"))).alias("first_key"), F.when(known, edge(F.col("leaf") + 1) - 1).alias("last_key"),
        F.col("m_row_count").alias("row_count"), F.col("f_row_count").alias("found_count"))


def damaged_rows(
    expected: DataFrame, found: DataFrame, key: str, columns: list[str], ranges: DataFrame, low: int, high: int, leaves: int = RANGES,
) -> DataFrame:
    """(key, problem) in damaged ranges of a table whose other copy is at hand: missing, added or changed rows.

    Rows outside the ranges are left out before anything is shuffled by key.
    """
    hit = settle(ranges.select(F.col("leaf").alias("_leaf")), "damage")

    def inside(df: DataFrame, side: str) -> DataFrame:
        part = content_parts(df, columns)[0]
        rows = df.select(leaf_of(df, key, low, high, leaves).alias("_leaf"), F.col(key).alias(f"{side}_key"), part.alias("_h"))
        return rows.join(hit, "_leaf", "left_semi").groupBy(f"{side}_key").agg(F.count(F.lit(1)).alias(f"{side}_n"), F.sum("_h").alias(f"{side}_h"))

    e, f = inside(expected, "e"), inside(found, "f")
    both = e.join(f, F.col("e_key").eqNullSafe(F.col("f_key")), "full")
    problem = F.when(F.col("f_n").isNull(), F.lit("missing")).when(F.col("e_n").isNull(), F.lit("added")).when(
        (F.col("e_n") != F.col("f_n")) | (F.col("e_h") != F.col("f_h")), F.lit("changed"))
    return both.withColumn("problem", problem).filter("problem is not null").select(F.coalesce("e_key", "f_key").alias(key), "problem")


def verify_apply(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """The catalog after verification: ``results(id, ok)``."""
    r = results.select(F.col("id").alias("r_id"), F.col("ok").alias("r_ok"))
    joined = catalog.join(r, F.col("id") == F.col("r_id"), "left")
    return joined.withColumn(
        "verified",
        F.when(F.col("r_ok"), F.lit("YES")).when(~F.col("r_ok"), F.lit("FAILED")).otherwise(F.col("verified")),
    ).withColumn("status", F.when(~F.col("r_ok"), F.lit("FAILED")).otherwise(F.col("status"))).select(*catalog.columns)


def verify_messages(catalog: DataFrame, results: DataFrame, now, worker) -> DataFrame:
    """One CRITICAL message row per failed dump."""
    failed = results.filter(~F.col("ok")).select(F.col("id").alias("r_id"))
    return catalog.join(failed, F.col("id") == F.col("r_id")).select(
        F.lit("CRITICAL").alias("level"), F.lit("verify").alias("tool"), s.moment(now).alias("logtime"),
        s.concat_null(F.lit("backup "), "bu_name", F.lit(" reported SUCCESS, verification reported ERROR")).alias("message"),
        F.lit("VERIFY").alias("jobclass"), F.col("id").alias("jobid"), F.lit(str(worker)).alias("bu_worker_id"),
    )


def schema_matches(schema_json: str, df: DataFrame) -> bool:
    """Stage-one check right after a dump: the stored schema reads and is the table's."""
    stored = T.StructType.fromJson(json.loads(schema_json))
    return [(f.name, f.dataType.simpleString()) for f in stored.fields] == [
        (f.name, f.dataType.simpleString()) for f in df.schema.fields
    ]
