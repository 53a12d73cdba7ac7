"""Corpus cleaning from raw documents to a training mix: five stages over one table.

Every stage takes all that its predecessor kept and returns the columns of ``documents``;
the last one returns the mix, a row per document in the order of its first training position.

1. quality: documents whose calibrated probability of good quality is below 0.7 go.
2. line dedup: boilerplate lines (on five sites or more) stay only at their first place; a
   document of which nothing is left goes; ``n_chars`` follows the text.
3. near duplicates: of each component of documents with five-word shingles 75% alike or more,
   the one with the smallest id stays.
4. decontamination: documents holding ten words in a row of a benchmark item go.
5. mixing: sources are mixed to their target weights along the curriculum.

Null texts: quality judges them as empty; later stages pass them on. Columns beyond those of
``documents`` are passed on by all stages but the last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import decontam, jaccard, line_dedup, mixing, quality
from keepsake.llm.common import held_out, prepare, read, unused
from keepsake.session import settle

# The classifier and the two dedup stages can't be said in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    lines, removed = unused(docs.columns, "n_lines"), unused(docs.columns, "n_removed")
    cut = line_dedup.drop_boilerplate(docs, counts=(lines, removed)).filter((F.col(removed) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.keep_one(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.by_first_use(mixing.mix(docs)).select("doc_id", "source", "size", "source_size", "target", "taken", "position")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
