"""Cross-site boilerplate lines, found by how many sites a line stands on.

A HyperLogLog sketch per line hash (64 bits of the trimmed line) is filled before the shuffle
and merged after it, so a line on millions of pages is one small row per task. Lines whose
estimate may lie on either side of the threshold, by ``SIGMAS`` standard errors, get an exact
distinct count of their sites. A line on ``min_sites`` sites or more is boilerplate: it goes
everywhere but at its first place (smallest id, then site, content and line number), so nothing is
lost for good.

Defined cases: a null text stays null and has no lines; a null site is a site of its own;
blank lines are left alone, as are lines of fewer than ``min_words`` words if that is asked
for; a text without boilerplate is returned
as it was, byte for byte. Rows with a null id or the same id are judged each for itself; only rows
alike in id, site and text are treated alike, as one place. An empty table gives no rows. A text is cut
in time linear in its lines. All columns of the input are kept, whatever their names; ``text`` and the
two counts are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import unused
from keepsake.session import settle

MIN_SITES = 5
MIN_WORDS = 1
LOG_K = 12
SIGMAS = 4


def site() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """Row key, site, line number and line hash of every line long enough to judge."""
    line = F.trim(F.col("line"))
    judged = F.col("line").rlike(r"\S")
    if min_words > 1:  # one word a line that is not blank has
        judged &= F.size(F.split(line, r"\s+")) >= min_words
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"),
            site().alias("site"),
            F.posexplode(F.split("text", "\n")).alias("at", "line"),
        )
        .filter(judged)
        .select("doc_id", "content", "site", "at", F.xxhash64(line).alias("h"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hash, spread and first place of every line on ``min_sites`` sites or more."""
    spread = settle(
        lines.groupBy("h").agg(
            F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "site", "content", "at")).alias("first")
        ).filter(F.col("n") >= min_sites).select("h", "n", "first", F.hll_sketch_estimate("sketch").alias("sites")),
        "line-spread",
    )
    margin = max(1.0, SIGMAS * 1.04 / 2 ** (LOG_K / 2) * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= margin
    counted = (
        lines.join(spread.filter(near).select("h"), "h", "left_semi").select("h", "site").distinct()
        .groupBy("h").agg(F.count("*").alias("exact"))
    )
    return spread.join(counted, "h", "left").withColumn("sites", F.coalesce("exact", "sites")).filter(
        F.col("sites") >= min_sites
    ).select("h", "sites", "n", "first")


def without(parts: Column, gone: Column) -> Column:
    """The lines of an array without those at sorted places, as the runs between them."""
    both = F.struct(parts.alias("lines"), F.concat(F.array(F.lit(-1)), gone, F.array(F.size(parts))).alias("edges"))

    def cut(x):
        lines, edges = x["lines"], x["edges"]
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(edges) - 1),
            lambda k: F.slice(lines, F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1) - 1),
        ))

    # an array of one, so that the lines are split once and not at every run
    return F.get(F.transform(F.array(both), cut), 0)


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counts: tuple = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and the numbers of lines and of removed ones, named as in ``counts``."""
    kept = [f"`{c}`" for c in docs.columns if c not in ("text", *counts)]
    content, place, key, spot, own = (unused(docs.columns, name) for name in ("content", "place", "key", "spot", "gone"))
    lines = settle(lines_of(docs, min_words), "lines")
    found = settle(boilerplate(lines, min_sites), "boilerplate")
    here = F.struct("doc_id", "site", "content", "at")
    gone = (
        lines.join(found.select("h", "first"), "h").filter(~F.col("first").eqNullSafe(here))
        .groupBy(F.col("doc_id").alias(key), F.struct("content", "site").alias(spot)).agg(F.array_sort(F.collect_set("at")).alias(own))
    )
    marked = docs.withColumn(content, F.xxhash64("text")).withColumn(place, F.struct(F.col(content).alias("content"), site().alias("site")))
    joined = marked.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(place) == F.col(spot)), "left")
    parts = F.split("text", "\n")
    return joined.select(
        *kept, F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(without(parts, F.col(own)), "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias(counts[0]),
        F.coalesce(F.array_size(own), F.lit(0)).alias(counts[1]),
    )
