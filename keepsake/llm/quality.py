"""Document quality by random-indexing word vectors and a small calibrated network.

Words are maximal runs of one kind of byte (lower case or non-ASCII, capitals, digits,
punctuation). A word is hashed to one of ``WORDS`` entries; each entry has a fixed sparse random
index vector, and its word vector is the sum of the index vectors met around it over all
documents, scaled to length 1, plus its own. Documents pool their word vectors: mean and
deviation of each component, the mean agreement of neighbours, and the logarithm of the
number of words.

The network (one hidden layer, numpy) learns on at most ``SAMPLE`` labelled rows, the first
by hash of their id. A fifth of them is set apart; on it the logit is divided by the
temperature of least cross entropy. Word vectors are one table of fixed size (``WORDS`` x
``SIZE``), so what is summed, collected and broadcast does not grow with the data.

Defined cases: null and empty texts have no words, pooled values 0, and get the score the network
gives those; labels that are null or disagree for one id are not learned from; ids may repeat
or be null. Without both labels to learn from the score is the share of label 1 (0.5 without
labels). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import textblocks as tb
from keepsake.llm.common import summed_slices, unused

WORDS = 1 << 15
SIZE = 32
NONZERO = 2
WINDOW = 2
SLICES = 64
SAMPLE = 20_000
CHUNK = 1 << 16  # bytes of text at once; a word's arrays are many times its size
HIDDEN = 24
THRESHOLD = 0.7
FEATURES = 2 * SIZE + 2
# Kind of each byte: 0 white space, 1 lower case and non-ASCII, 2 capitals, 3 digits, 4 other.
KIND = np.array([
    0 if b == 0x20 or 9 <= b <= 13 else 1 if b >= 0x80 or 0x61 <= b <= 0x7A else 2 if 0x41 <= b <= 0x5A else 3 if 0x30 <= b <= 0x39 else 4
    for b in range(256)
], dtype=np.uint8)


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry number of every word and the text it stands in."""
    kind = KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    return (tb.span_hashes(data, start, end) % np.uint64(WORDS)).astype(np.int64), np.searchsorted(offsets, start, "right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each entry's index vector."""
    h = tb.mix(np.arange(WORDS * NONZERO, dtype=np.uint64) + np.uint64(0x5EED)).reshape(WORDS, NONZERO)
    return (h % np.uint64(SIZE)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def texts_in(column):
    data, offsets = tb.utf8(column)
    for i, j in tb.chunks(offsets, CHUNK):
        yield i, j, *entries(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def add_neighbours(total: np.ndarray, column, place: np.ndarray, sign: np.ndarray) -> None:
    """Add to the entries' counters the index vectors met around each word of the texts."""
    for _, _, entry, text in texts_in(column):
        for gap in range(1, WINDOW + 1):
            near = np.flatnonzero(text[gap:] == text[:-gap])
            for here, there in ((entry[near], entry[near + gap]), (entry[near + gap], entry[near])):
                for k in range(NONZERO):
                    np.add.at(total, here * SIZE + place[there, k], sign[there, k])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors from the neighbours of all words of all documents."""

    def run(batches):
        place, sign = index_vectors()
        total = np.zeros(WORDS * SIZE, np.int64)
        for batch in batches:
            add_neighbours(total, batch.column(0), place, sign)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * SLICES, pa.int32()),
            pa.array([p.astype(np.int32).tobytes() for p in np.array_split(total, SLICES)], pa.binary()),
        ], ["slice", "part", "counters"])

    sums = summed_slices(docs.select("text").mapInArrow(run, "slice int, part int, counters binary"), "int32")
    vectors = np.concatenate([np.frombuffer(sums[i], np.int64) for i in range(SLICES)]) if sums else np.zeros(WORDS * SIZE)
    vectors = vectors.reshape(WORDS, SIZE).astype(np.float64)
    length = np.sqrt((vectors ** 2).sum(1, keepdims=True))
    vectors /= np.where(length > 0, length, 1)
    place, sign = index_vectors()
    np.add.at(vectors, (np.arange(WORDS)[:, None], place), sign / np.sqrt(NONZERO))
    return vectors.astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """The features of each text of a batch."""
    out = [np.zeros((0, FEATURES))]
    for i, j, entry, text in texts_in(column):
        n = np.bincount(text, minlength=j - i)
        rows = np.zeros((j - i, FEATURES))
        some = np.flatnonzero(n)
        if len(some):
            starts = (np.cumsum(n) - n)[some]
            v = vectors[entry]
            mean = np.add.reduceat(v, starts, axis=0, dtype=np.float64) / n[some, None]
            v *= v
            square = np.add.reduceat(v, starts, axis=0, dtype=np.float64) / n[some, None]
            same = np.append((entry[1:] == entry[:-1]) & (text[1:] == text[:-1]), False)
            rows[some, :SIZE] = mean
            rows[some, SIZE:2 * SIZE] = np.sqrt(np.maximum(square - mean * mean, 0))
            rows[some, -2] = np.add.reduceat(same, starts, dtype=np.int64) / n[some]
            rows[some, -1] = np.log1p(n[some])
        out.append(rows)
    return np.concatenate(out)


class Network:
    """Two layers and a temperature; plain arrays, so that it travels in a task's closure."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float) -> Network:
    logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), logit)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, decay: float = 1e-3) -> Network:
    """Adam on cross entropy over four fifths of the rows, the temperature on the rest."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    apart, rows = order[: len(y) // 5], order[len(y) // 5:]
    mean, scale = x[rows].mean(0), x[rows].std(0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rng.shuffle(rows)
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(rows), batch):
            r = rows[at:at + batch]
            hidden = np.tanh(z[r] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-(hidden @ params[2] + params[3]))) - y[r]) / len(r)
            back = np.outer(error, params[2]) * (1 - hidden ** 2)
            grads = [z[r].T @ back + decay * params[0], back.sum(0), hidden.T @ error + decay * params[2], np.array([error.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * first[i] / (1 - 0.9 ** t) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    model = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    logits, target = model.logits(x[apart]), y[apart]
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(target > 0, -logits, logits) / g).mean() for g in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, learn, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """Network from the labelled rows that satisfy ``learn`` (a condition on doc_id), at most ``sample`` ids."""
    known = labels.filter(learn).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    known = known.select("doc_id", F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text", "doc_id")

    def run(batches):
        for batch in batches:
            rows = pooled(batch.column(1), vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2)], ["label", "x", "doc_id"])

    # one row an id: of different texts under one id the one whose features come first
    rows = picked.mapInArrow(run, picked.select("label", F.lit(b"").alias("x"), "doc_id").schema)
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("row")).select("row.*").toArrow()
    y = got["label"].to_numpy()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), FEATURES).astype(np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)  # independent of the order rows arrive in
    return fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, learn, columns: list[str], sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and ``score`` (or another ``name``), the probability of label 1."""
    vectors = word_vectors(docs)
    model = train(docs, labels, learn, vectors, sample)
    inputs = docs.select(*(f"`{c}`" for c in columns), F.col("text").alias(unused([*columns, name], "scored_text")))
    schema = docs.select(*(f"`{c}`" for c in columns), F.lit(0.0).alias(name)).schema

    def run(batches):
        for batch in batches:
            x = pooled(batch.column(batch.num_columns - 1), vectors)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.score(x), pa.float64())], schema.names)

    return inputs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, learn, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold."""
    name = unused(docs.columns, "score")
    return score(docs, labels, learn, docs.columns, name=name).filter(F.col(name) >= threshold).drop(name)
