"""Exact top-k inner products by multi-resolution segment statistics.

Components are made integers (floor of 256 times their value), so a score is one exact
integer. A vector cut into segments has a mean and a deviation per segment; for a segment of
m components, ``m * (mean * mean' + dev * dev')`` is never below its inner product (the same
statement as the lower bound on the distance). Within a pair of blocks all rows are bounded
at one segment, then at more, each time leaving out what cannot reach the k-th best score
known so far; the survivors get their exact score. Bounds carry a small margin for rounding.

Queries are asked against all rows, in blocks: a vector block meets a query block as one group
of bounded size, whose answer is k rows per query. The best k of those are kept per query.

Defined cases: null vectors, vectors with null, NaN or infinite components and rows without
an id take no part. Only vectors of the same length are compared; of no components the score
is 0. Rows that repeat an id are candidates each, and the id is asked once per different
vector; a row is never a candidate of its own id. Ties go to the smaller id. Scores must fit
a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
ROWS, QUERIES = 4096, 1024
EXACT_IN_FLOAT = float(1 << 53)
ANSWER = pa.schema([("query_id", pa.int64()), ("asked", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows that take part, with integer components."""
    usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * 256)).cast("array<long>").alias("v"),
    )


def resolutions(length: int) -> list[int]:
    """Segment counts from coarse to fine; the finest leaves segments of about four components."""
    out, n = [], 1
    while n * 4 <= length:
        out.append(n)
        n *= 4
    return out or [1]


def summaries(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of each segment, scaled by the root of its length, side by side."""
    columns = []
    for seg in np.array_split(x, parts, axis=1):
        root = np.sqrt(seg.shape[1])
        columns += [seg.mean(1) * root, seg.std(1) * root]
    return np.stack(columns, 1)


def scores(rows: np.ndarray, query: np.ndarray, peak: float) -> np.ndarray:
    """Exact integer inner products; in doubles where those are exact."""
    return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64) if peak < EXACT_IN_FLOAT else rows @ query


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """For each query its k best rows (index, score), by bounds from coarse to fine and then exactly."""
    length = x.shape[1]
    if not length:
        x, q, length = np.zeros((len(x), 1), np.int64), np.zeros((len(q), 1), np.int64), 1
    peak = float(length) * max(1.0, float(np.abs(x).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0)))
    margin = 1e-9 * peak + 1e-3
    levels = [(summaries(x.astype(np.float64), p), summaries(q.astype(np.float64), p)) for p in resolutions(length)]
    coarse = levels[0][1] @ levels[0][0].T
    for i in range(len(q)):
        alive = np.flatnonzero(ids != query_ids[i])
        if len(alive) > k:
            bound = coarse[i, alive]
            finest = levels[-1]
            tried = alive[np.argpartition(finest[0][alive] @ finest[1][i], -k)[-k:]]
            floor = scores(x[tried], q[i], peak).min()
            alive = alive[bound + margin >= floor]
            for rows_at, query_at in levels[1:]:
                alive = alive[rows_at[alive] @ query_at[i] + margin >= floor]
        exact = scores(x[alive], q[i], peak)
        first = np.lexsort((ids[alive], -exact))[:k]
        yield i, alive[first], exact[first]


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten()).reshape(len(flat), -1).astype(np.int64) if len(flat) else np.zeros((0, 0), np.int64)


def search(vectors: DataFrame, is_query, k: int = K, column: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each row that ``is_query`` (a condition on vec_id)."""
    usable = integer_vectors(vectors, column).withColumn("length", F.size("v"))
    asked = usable.filter(is_query).dropDuplicates(["vec_id", "v"])
    n = usable.agg(F.count("*"), F.count_if(is_query)).first()
    groups, blocks = max(1, -(-n[0] // rows)), max(1, -(-n[1] // queries))
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    left = usable.select("length", spread.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "vec_id", "v")
    right = asked.select(F.col("length").alias("query_length"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_g"), part.alias("query_b"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def answer(key, table, wanted):
        if not table.num_rows or not wanted.num_rows:
            return ANSWER.empty_table()
        out = ([], [], [])
        ids, x = table["vec_id"].to_numpy(), matrix(table["v"])
        query_ids, q = wanted["query_id"].to_numpy(), matrix(wanted["q"])
        for i, row, score in best(ids, x, query_ids, q, k):
            out[0].append(np.full(len(row), i))
            out[1].append(ids[row])
            out[2].append(score)
        which, found, score = (np.concatenate(o) for o in out)
        return pa.table({
            "query_id": wanted["query_id"].take(pa.array(which)), "asked": wanted["q"].take(pa.array(which)),
            "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64()),
        })

    pairs = left.groupBy("length", "g", "b").cogroup(right.groupBy("query_length", "query_g", "query_b"))
    partial = pairs.applyInArrow(answer, "query_id long, asked array<long>, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("asked", F.xxhash64("asked")).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k
    ).select("query_id", "rank", "vec_id", "score")
