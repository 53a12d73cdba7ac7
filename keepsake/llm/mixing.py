"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source gets a target number of words (``source_targets``). Its words are laid out in one
line: all documents in the order of the md5 of their id, then all again, up to the target; the
document at the end is cut there, so the words taken are the target, rounded down. The share a
source has of the training changes over time by its schedule, a line through evenly spaced
knots. The integral of the schedule is the source's demand up to a moment; the moment at which
the demand reaches a document's place in the line is its training position (0 to 1). Sorted
by position, by range, all sources together give the curriculum.

A document's place needs the words before it in its source. They are added in three steps,
256 sums per source, 256 sums below each, and the documents below those, so that no task holds
a source, hot or not. Tables of one row per source are the only ones sorted in one task.

Defined cases: null or empty texts have no words and are not taken (position null); a null
source is a source of its own, last in order; ids may repeat or be null, each row counts; with
no words at all every target is 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepsake.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
# Knots of the relative share over training time, one schedule per weight: even, falling, rising.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def sized(docs: DataFrame) -> DataFrame:
    """Word count, source name that is never null (``s``), and the two bucket levels of each document."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("place"), F.substring(order, 1, 2).alias("b1"), F.substring(order, 3, 2).alias("b2"),
    )


def source_targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets of ``totals(s, source, source_size)``: by weight, none above ``repeats`` times its source.

    The excess of full sources goes to the others by weight. With the sources sorted by
    capacity per weight, those before some place are full and the level of the rest follows
    from what is left; the right place is the first whose own capacity reaches that level.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        totals.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("kind", F.col("number") % len(weights))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1))
        .withColumn("room", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("room") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("weighing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weighing"))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number")))
    return rows.withColumn("level", level.over(everything)).select(
        "s", "source_size", "kind", F.least(F.col("room").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def moment(q: Column, kind: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time at which a source has had the part ``q`` of its demand: the inverse of the schedule's integral."""
    tables = []
    for knots in schedules:
        n = len(knots) - 1
        mean = sum((a + b) / 2 for a, b in zip(knots, knots[1:])) / n
        done, parts = 0.0, []
        for i, (a, b) in enumerate(zip(knots, knots[1:])):
            a, b = a / mean, b / mean
            parts.append(F.struct(F.lit(i).alias("i"), F.lit(done).alias("done"), F.lit(a).alias("a"), F.lit(b - a).alias("d")))
            done += (a + b) / 2 / n
        tables.append(F.array(*parts))
    n = len(schedules[0]) - 1
    part = F.element_at(F.filter(F.element_at(F.array(*tables), kind + 1), lambda p: p["done"] <= q), -1)
    rest = (q - part["done"]) * n
    slope = part["a"] + F.sqrt(F.greatest(part["a"] * part["a"] + 2 * part["d"] * rest, F.lit(0.0)))
    return F.least((part["i"] + F.coalesce(F.try_divide(2 * rest, slope), F.lit(0.0))) / n, F.lit(1.0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per document with its target, the words taken, and ``places``: epoch, words and position of every use."""
    rows = settle(sized(docs), "mix-sizes")
    leaf = rows.groupBy("s", "b1", "b2").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    inner = Window.partitionBy("s", "b1").orderBy("b2")
    outer = Window.partitionBy("s").orderBy("b1")
    upper = leaf.groupBy("s", "b1").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    targets = source_targets(
        upper.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, share, repeats
    )
    upper = upper.select("s", "b1", (F.sum("size").over(outer) - F.col("size")).alias("upper"))
    leaf = (
        leaf.select("s", "b1", "b2", (F.sum("size").over(inner) - F.col("size")).alias("lower"))
        .join(upper, ["s", "b1"]).join(targets, "s")
        .select("s", "b1", "b2", (F.col("lower") + F.col("upper")).alias("base"), "source_size", "kind", "target")
    )
    leaf = settle(leaf, "mix-places")
    own = Window.partitionBy("s", "b1", "b2").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("base") + F.sum("size").over(own) - F.col("size")

    def use(epoch: int) -> Column:
        at = F.col("start") + F.col("source_size") * epoch
        words = F.greatest(F.least(F.floor("target") - at, F.col("size")), F.lit(0))
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), moment(at / F.col("target"), F.col("kind"), schedules).alias("position"))

    placed = rows.join(leaf, ["s", "b1", "b2"]).withColumn("start", start)
    uses = F.filter(F.array(*[use(e) for e in range(repeats)]), lambda u: u["words"] > 0)
    return placed.select("doc_id", "source", "size", "source_size", "target", "place", uses.alias("places")).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("places", F.lit(0).cast("long"), lambda n, u: n + u["words"]).alias("taken"), "places", "place",
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """Every use of a document as a row, sorted by training position over range partitions."""
    return mixed.select("doc_id", "source", F.explode("places").alias("u")).select(
        "doc_id", "source", "u.epoch", "u.words", "u.position"
    ).orderBy("position", "doc_id", "epoch")


def by_first_use(mixed: DataFrame) -> DataFrame:
    """One row per document, sorted by its first position; unused ones follow, spread by their place."""
    first = F.get("places", F.lit(0))["position"]
    return mixed.withColumn("position", F.round(first, 9)).orderBy(F.coalesce("position", F.lit(2.0)), "place", "doc_id").drop("place")
