"""Documents resampled towards a target distribution, by importance weights of hashed word runs.

Features are runs of one to ``RUNS`` words; a feature's bucket is the CRC-32 of its text modulo
the number of buckets. The feature texts are never built. The distinct words of a chunk of texts
make an Aho-Corasick dictionary, each word between two delimiters and carrying its CRC and length
as payload. One scan of the chunk emits the payloads in order, and neighbouring payloads compose:
the CRC of "a b" is the CRC of "a" moved on by the length of " b", which is linear and one table
look-up per byte of the register, plus the CRC of " b".

Two scans of the corpus: the first adds up one counter per bucket, the second takes the mean of
the buckets' gains over a document's features as its weight. The weight plus Gumbel noise from a
hash of the id is its score, and the highest scores are the sample (drawing without replacement).
Scores are whole numbers of a narrow range, so a table of their counts gives the score of the
last one drawn; only documents from there on are sorted, by range.

Defined cases: null or empty texts have no features and weight 0; null ids enter the hash as
empty text; repeated documents are drawn each; of rows with equal score and id the one of fewer
features ranks first. Without documents there are no rows, without target texts all t are 0.
Words of any length and bytes that are no UTF-8 count as they stand. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import textblocks as tb
from keepsake.llm.ranks import sorted_once, with_places
from keepsake.session import settle

BUCKETS, RUNS, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
CHUNK = 4 << 20
# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
END = "\n"
# Lower-cased word bytes; all other bytes become the delimiter.
DELIMITED = bytes(int(tb.LOWER[b]) if tb.ALNUM[b] else 0x20 for b in range(256))


def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given by the images of the single bits, applied to each ``x``."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
    return out


def one_byte() -> np.ndarray:
    """The map that moves a CRC register on by one zero byte."""
    out = []
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        out.append(c)
    return np.array(out, np.uint32)


def shift_table(length: int) -> np.ndarray:
    """Registers moved on by ``length`` bytes: for each of their 4 bytes 256 images to be added."""
    moved, power = np.uint32(1) << np.arange(32, dtype=np.uint32), one_byte()
    while length:
        if length & 1:
            moved = times(power, moved)
        power, length = times(power, power), length >> 1
    value = np.arange(256, dtype=np.uint32)
    return np.stack([times(moved, value << np.uint32(8 * k)) for k in range(4)])


class Shifts:
    """Shift tables by length, made when first needed; the usual lengths are kept."""

    KEPT = 4096

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        lengths, which = np.unique(length, return_inverse=True)
        if len(self.tables) > self.KEPT:
            self.tables = {}
        for n in lengths.tolist():
            if n not in self.tables:
                self.tables[n] = shift_table(n)
        if not len(lengths):
            return crc
        flat = np.concatenate([self.tables[n].reshape(-1) for n in lengths.tolist()])
        at, out = which * 1024, np.zeros_like(crc)
        for k in range(4):
            out ^= flat[at + 256 * k + (crc >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
        return out


def payloads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC, length and text number of every word of delimited texts, emitted by one scan."""
    import ahocorasick

    found = set()
    for text in texts:
        found.update(text.split())
    automaton = ahocorasick.Automaton()
    automaton.add_word(END, -1)
    for word in found:
        automaton.add_word(f" {word.decode('utf-8', 'surrogateescape')} ", zlib.crc32(word) | len(word) << 32)
    automaton.make_automaton()
    line = b" " + b" \n ".join(texts) + b" \n"
    emitted = np.fromiter(map(itemgetter(1), automaton.iter(line.decode("utf-8", "surrogateescape"))), np.int64)
    ends = emitted < 0
    owner = np.cumsum(ends)[~ends]
    emitted = emitted[~ends]
    return (emitted & 0xFFFFFFFF).astype(np.uint32), emitted >> 32, owner


def buckets_of(texts: list[bytes], runs: int, buckets: int, shifts: Shifts):
    """For each run length, the buckets and text numbers of all features."""
    crc, length, owner = payloads(texts)
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    tail = shifts(space, length) ^ crc
    run, last = crc, owner
    for k in range(runs):
        if k:
            same = last[:-1] == owner[k:]
            run = shifts(run[:-1], length[k:] + 1) ^ tail[k:]
            yield (run[same] % np.uint32(buckets)).astype(np.int64), owner[k:][same]
            last = np.where(same, owner[k:], -1)
        else:
            yield (run % np.uint32(buckets)).astype(np.int64), owner


def chunks_of(column):
    """Delimited texts of a batch, chunk by chunk, with the place of the first."""
    data, offsets = tb.utf8(column)
    for i, j in tb.chunks(offsets, CHUNK):
        line, at = data[offsets[i]:offsets[j]].tobytes().translate(DELIMITED), (offsets[i:j + 1] - offsets[i]).tolist()
        yield i, j, [line[a:b] for a, b in zip(at, at[1:])]


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket. Tasks send one number per bucket; so many reach the driver."""

    def count(batches):
        total, shifts = np.zeros(buckets, np.int64), Shifts()
        for batch in batches:
            for _, _, texts in chunks_of(batch.column(0)):
                for found, _ in buckets_of(texts, runs, buckets, shifts):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log of its smoothed share in the target over that in the source."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """Per document ``doc_id, n_words, n_features, weight``."""
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_words", "n_features", "weight")])

    def weigh(batches):
        shifts = Shifts()
        for batch in batches:
            for i, j, texts in chunks_of(batch.column(1)):
                words, n, total = None, np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for found, owner in buckets_of(texts, runs, len(gain), shifts):
                    got = np.bincount(owner, minlength=j - i)
                    words, n = got if words is None else words, n + got
                    np.add.at(total, owner, gain[found])
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, (words, n, mean))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT,
    runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Every document with ``n_words, n_features, weight, score`` and its ``rank`` in the sample, null if it is not drawn.

    ``percent`` of the documents with ``least`` words or more are drawn.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settle(weights(docs, gain, runs).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least
    # scores are a log ratio and a log of a 32-bit fraction in thousandths: some ten thousand values at any size
    held = sorted(((r["score"], r["n"]) for r in scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw, limit, seen = percent * sum(n for _, n in held) // 100, None, 0
    for score, n in held:
        if seen < draw:
            limit, seen = score, seen + n
    if limit is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= limit)
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()
    ranked = with_places(sorted_once(scored.filter(near), "drawn", *order))
    rank = F.when(F.col("pos") < draw, F.col("pos") + 1)
    return ranked.select(*scored.columns, rank.alias("rank")).union(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))
