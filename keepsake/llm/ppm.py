"""Language-model scoring by prediction by partial matching over bytes, and a word baseline.

Texts are lower-cased (A-Z) byte sequences closed by one end symbol (0xFF, which UTF-8 never
holds); before the first byte the context is filled with the same symbol. The pretrained
model is the trie of all contexts of up to ``order`` bytes in the training texts. A symbol is
coded at the longest context where it was seen; every longer context costs an escape
(method C: the escape weighs as much as the context has distinct symbols), and the symbols of
the longer context are excluded below. Under the empty context the rest of the 256 symbols
share the last escape evenly.

The trie never stands in one place. Texts are dealt to blocks of a few MB; a block sends its
distinct (context, symbol) keys and words, with training counts, to buckets. A bucket holds
all contexts with the same last two bytes, adds the counts of all blocks, and answers each
block with the log probability of its keys (the total count of its words). Contexts of fewer
than two bytes are a table of 65,536 counts, whatever the input. Answers hold no keys: a block
finds them again in the same order. They hold each distinct double once and a code per key, so
nothing is rounded on the way. A block is one group, made by a hash of id and text, and
as large as its texts; counts are added per block before they are shuffled, so a frequent
word or context is one entry per block. Texts are shuffled once, for both of their uses, and
nothing is written in between.

Defined cases: a null text is empty and is scored as the end symbol alone. A null id is
training. Rows with the same id or text are scored each for itself. An empty table gives no
rows. Without training texts every symbol costs 1/256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import textblocks as tb
from keepsake.llm.common import block_of, blocks_for, bytes_of

END = 0xFF
ORDER = 6
BLOCK_BYTES = 12 << 20
ALPHA = 0.1
HELD_WORDS = 1 << 21  # distinct words a task gathers before it passes them on
END_WORD = np.uint64(0)
WORDS, GRAMS = 0, 1
UNITS = "kind int, bucket int, block int, m int, keys binary, counts binary"
ANSWERS = "kind int, bucket int, block int, codes binary, k int, entries binary"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, n_bytes long"
)


def mask(n: int) -> np.uint64:
    """The last n bytes of a key."""
    return np.uint64((1 << (8 * n)) - 1)


def keys_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) key of every symbol, end symbols included, and the first key of each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    padded = np.full(len(data) + n * (order + 1), END, np.uint8)
    shift = np.repeat(np.arange(n) * (order + 1) + order, sizes)
    padded[np.arange(len(data)) + shift] = data
    keys = np.zeros(len(padded) - order, np.uint64) if n else np.zeros(0, np.uint64)
    for k in range(order + 1 if n else 0):
        keys = (keys << np.uint64(8)) | padded[k:len(keys) + k].astype(np.uint64)
    # keys[i] ends at padded[i + order]; each text owns its bytes and its end symbol
    first = offsets[:-1] + np.arange(n)
    own = np.arange(len(data) + n) + np.repeat(np.arange(n) * order, sizes + 1)
    return keys[own], first


def gram_chunks(data: np.ndarray, offsets: np.ndarray, order: int):
    """Per chunk of texts: first and last text, key of every symbol, first key of each text."""
    for i, j in tb.chunks(offsets):
        keys, first = keys_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], order)
        yield i, j, keys, first


def word_chunks(data: np.ndarray, offsets: np.ndarray):
    """Per chunk of texts: first and last text, hash of every word and of every text's end, text of each."""
    for i, j in tb.chunks(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        start, end, text = tb.words(part, at, tb.SOLID)
        yield i, j, np.append(tb.span_hashes(part, start, end), np.full(j - i, END_WORD)), np.append(text, np.arange(j - i))


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each stands there."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], np.diff(np.append(at, len(ordered)))


def counted(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of training texts with their counts, then those of the other texts with 0."""
    found, n = runs(np.sort(values[train]))
    other, _ = runs(np.sort(values[~train]))
    return np.concatenate([found, other]), np.concatenate([n, np.zeros(len(other), np.int64)])


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a chunk in order, and the rank of every value among them."""
    order = np.argsort(values)
    found, n = runs(values[order])
    rank = np.empty(len(values), np.int32)
    rank[order] = np.repeat(np.arange(len(found), dtype=np.int32), n)
    return found, rank


def merged(parts, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all parts, added every few parts so that memory follows the result."""
    held = []
    for part in parts:
        held.append(part)
        if len(held) > step:
            held = [tb.group_sums(*(np.concatenate(x) for x in zip(*held)))]
    return tb.group_sums(*(np.concatenate(x) for x in zip(*held)))


def distinct(texts, train: np.ndarray, order: int):
    """Distinct sorted keys and words of a block with their training counts; memory is that of a chunk and the result."""
    data, offsets = tb.utf8(texts)
    data = tb.LOWER[data]
    grams = (
        counted(keys, np.repeat(train[i:j], np.diff(offsets[i:j + 1]) + 1)) for i, j, keys, _ in gram_chunks(data, offsets, order)
    )
    words = (counted(hashes, train[i + text]) for i, _, hashes, text in word_chunks(data, offsets))
    return [merged(part) for part in (grams, words)]


def packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; sorted ones as differences."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def coded(values: np.ndarray) -> tuple[bytes, int, bytes]:
    """A code per value, the number of distinct values, and those."""
    entries, codes = np.unique(values, return_inverse=True)
    return packed(codes.astype(np.uint32)), len(entries), packed(entries)


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Words by their hash, keys by the last two bytes of their context."""
    if kind == GRAMS:
        keys = (keys >> np.uint64(8)) & mask(2)
    return (tb.mix(keys + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def dealt(kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket and key, the buckets that occur, and where each begins and ends."""
    bucket = bucket_of(kind, keys, buckets)
    order = np.lexsort((keys, bucket))
    there, at = np.unique(bucket[order], return_index=True)
    return order, there, np.append(at, len(keys))


def send(block: int, parts, buckets: int) -> pa.Table:
    rows = []
    for kind, (keys, counts) in parts:
        order, there, at = dealt(kind, keys, buckets)
        keys, counts = keys[order], counts[order]
        for b, i, j in zip(there.tolist(), at[:-1].tolist(), at[1:].tolist()):
            rows.append((kind, b, block, j - i, packed(np.diff(keys[i:j], prepend=np.uint64(0))), packed(counts[i:j].astype(np.uint32))))
    kinds, where, blocks, m, k, c = zip(*rows) if rows else ([],) * 6
    return pa.table({
        "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(where, pa.int32()), "block": pa.array(blocks, pa.int32()),
        "m": pa.array(m, pa.int32()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary()),
    })


def low_counts(texts: DataFrame) -> tuple[np.ndarray, int, int]:
    """Of the training texts: counts of symbol after byte (256 x 256, whatever the input), all words, distinct words."""

    def rows(pair: np.ndarray, word: np.ndarray, n: np.ndarray):
        return pa.RecordBatch.from_arrays(
            [pa.array(pair, pa.int32()), pa.array(word.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["pair", "word", "n"]
        )

    def count(batches):
        total, held = np.zeros(1 << 16, np.int64), []
        for batch in batches:
            data, offsets = tb.utf8(batch.column(0))
            data = tb.LOWER[data]
            for i, j in tb.chunks(offsets):
                keys, _ = keys_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], 1)
                total += np.bincount(keys.astype(np.int64), minlength=1 << 16)
            held += [runs(np.sort(hashes)) for _, _, hashes, _ in word_chunks(data, offsets)]
            if sum(len(found) for found, _ in held) > HELD_WORDS:
                held = [tb.group_sums(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD_WORDS // 2:
                    yield rows(np.full(len(held[0][0]), -1), *held.pop())
        if held:
            found, n = tb.group_sums(*(np.concatenate(x) for x in zip(*held)))
            yield rows(np.full(len(found), -1), found, n)
        pair = np.flatnonzero(total)
        yield rows(pair, np.zeros(len(pair), np.uint64), total[pair])

    sums = texts.mapInArrow(count, "pair int, word long, n long").groupBy("pair", "word").agg(F.sum("n").alias("n"))
    out, words, known = np.zeros((256, 256), np.int64), 0, 0
    for pair, n, v in sums.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        if pair < 0:
            words, known = n, v
        else:
            out[pair >> 8, pair & 255] = n
    return out, words, known


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """log10 P(symbol | context) of distinct sorted keys, which hold every trained key of their last two context bytes."""
    result = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    trained = keys[counts > 0], counts[counts > 0]
    above = None  # contexts one byte longer, their distinct symbols, their key array
    skip_n = np.zeros(len(keys), np.int64)  # mass and number of excluded symbols at the present level
    skip_d = np.zeros(len(keys), np.int64)

    def place(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, wanted), max(0, len(values) - 1))
        return at, (values[at] == wanted) if len(values) else np.zeros(len(wanted), bool)

    def step(seen: np.ndarray, c: np.ndarray, n: np.ndarray, d: np.ndarray, known: np.ndarray) -> None:
        """Code at this level where the symbol was seen, else pay the escape."""
        nonlocal open_
        total = n - skip_n + d - skip_d
        usable = open_ & known & (total > 0)
        hit = usable & seen
        result[hit] += np.log10(c[hit] / total[hit])
        miss = usable & ~seen & (d > skip_d)
        result[miss] += np.log10((d - skip_d)[miss] / total[miss])
        open_ &= ~hit

    for k in range(order, 1, -1):
        at_k, c_k = tb.group_sums(trained[0] & mask(k + 1), trained[1])
        contexts, n_k = tb.group_sums(at_k >> np.uint64(8), c_k)
        _, d_k = tb.group_sums(at_k >> np.uint64(8), np.ones(len(at_k), np.int64))
        if above is not None:
            longer, d_long, long_keys = above
            at, ok = place(at_k, long_keys & mask(k + 1))
            _, lost = tb.group_sums(long_keys >> np.uint64(8), np.where(ok, c_k[at], 0) if len(c_k) else np.zeros(0, np.int64))
            at, ok = place(longer, (keys & mask(k + 2)) >> np.uint64(8))
            skip_n = np.where(ok, lost[at], 0) if len(lost) else np.zeros(len(keys), np.int64)
            skip_d = np.where(ok, d_long[at], 0) if len(lost) else np.zeros(len(keys), np.int64)
        at, known = place(contexts, (keys & mask(k + 1)) >> np.uint64(8))
        n, d = (np.where(known, x[at], 0) if len(x) else np.zeros(len(keys), np.int64) for x in (n_k, d_k))
        at, seen = place(at_k, keys & mask(k + 1))
        c = np.where(seen, c_k[at], 0) if len(c_k) else np.zeros(len(keys), np.int64)
        step(seen, c, n, d, known)
        above = contexts, d_k, at_k

    byte, symbol = ((keys >> np.uint64(8)) & mask(1)).astype(np.int64), (keys & mask(1)).astype(np.int64)
    if above is not None:
        longer, d_long, long_keys = above
        lost = low[((long_keys >> np.uint64(8)) & mask(1)).astype(np.int64), (long_keys & mask(1)).astype(np.int64)]
        _, lost = tb.group_sums(long_keys >> np.uint64(8), lost)
        at, ok = place(longer, (keys & mask(3)) >> np.uint64(8))
        skip_n = np.where(ok, lost[at], 0) if len(lost) else skip_n * 0
        skip_d = np.where(ok, d_long[at], 0) if len(lost) else skip_d * 0
    n1, d1 = low.sum(1), (low > 0).sum(1)
    c = low[byte, symbol]
    step(c > 0, c, n1[byte], d1[byte], n1[byte] > 0)

    none = low.sum(0)
    skip_n, skip_d = ((low > 0) * none[None, :]).sum(1)[byte], d1[byte]
    d0 = int((none > 0).sum())
    c = none[symbol]
    step(c > 0, c, np.full(len(keys), none.sum()), np.full(len(keys), d0), np.full(len(keys), none.sum() > 0))
    if d0 < 256:
        result[open_] -= np.log10(256 - d0)
    return result


def ppm_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every row of ``docs(doc_id, held_out, text)`` by the model of the rows that are not held out.

    ``score`` is the model's log10 probability, ``base_score`` that of single words with the
    additive constant 0.1 (end of text counted as a word), ``n_known`` the words met in training.
    """
    if not 2 <= order <= 7:
        raise ValueError("order is 2 to 7: a key of context and symbol fits 64 bits")
    docs = docs.select("doc_id", "held_out", "text")
    size = bytes_of(docs)
    n_blocks = blocks_for(size, block_bytes)
    buckets = max(16, n_blocks)
    low, n, v = low_counts(docs.filter(~F.col("held_out")).select("text"))
    by_block = docs.withColumn("block", block_of(n_blocks, "doc_id", "text"))

    def units(key, table):
        grams, words = distinct(table["text"], ~table["held_out"].to_numpy(), order)
        return send(key[0].as_py(), [(GRAMS, grams), (WORDS, words)], buckets)

    def reply(key, table):
        kind = key[0].as_py()
        blocks = table["block"].to_pylist()
        sizes = table["m"].to_pylist()
        keys = [np.cumsum(unpacked(x, m, np.uint64), dtype=np.uint64) for x, m in zip(table["keys"].to_pylist(), sizes)]
        counts = np.concatenate([unpacked(x, m, np.uint32) for x, m in zip(table["counts"].to_pylist(), sizes)]).astype(np.int64)
        joined = np.concatenate(keys)
        found, total = tb.group_sums(joined, counts)
        values = total if kind == WORDS else log_probabilities(found, total, low, order)
        at = np.searchsorted(found, joined)
        ends = np.cumsum(sizes)
        codes, sizes_of, entries = zip(*(coded(values[at[e - m:e]]) for m, e in zip(sizes, ends)))
        return pa.table({
            "kind": pa.array([kind] * len(blocks), pa.int32()), "bucket": pa.array([key[1].as_py()] * len(blocks), pa.int32()),
            "block": pa.array(blocks, pa.int32()), "codes": pa.array(codes, pa.binary()),
            "k": pa.array(sizes_of, pa.int32()), "entries": pa.array(entries, pa.binary()),
        })

    answers = by_block.groupBy("block").applyInArrow(units, UNITS).groupBy("kind", "bucket").applyInArrow(reply, ANSWERS)

    def score(key, texts, replies):
        held = texts["held_out"].to_numpy()
        columns = ("kind", "bucket", "codes", "k", "entries")
        got = {row[:2]: row[2:] for row in zip(*(replies[x].to_pylist() for x in columns))}

        def answered(kind: int, parts, dtype) -> tuple[np.ndarray, np.ndarray]:
            """The distinct keys of all chunks and the answer to each."""
            keys, _ = runs(np.sort(np.concatenate(parts)))
            order_, there, at = dealt(kind, keys, buckets)
            out = np.empty(len(keys), dtype)
            for b, i, j in zip(there.tolist(), at[:-1].tolist(), at[1:].tolist()):
                codes, k, entries = got[kind, b]
                out[order_[i:j]] = unpacked(entries, k, dtype)[unpacked(codes, j - i, np.uint32)]
            return keys, out

        data, offsets = tb.utf8(texts["text"])
        data = tb.LOWER[data]
        scored, based, tokens, known = (np.zeros(len(held)) for _ in range(4))
        chunks = [(i, j, first, *ranked(keys)) for i, j, keys, first in gram_chunks(data, offsets, order)]
        grams, logs = answered(GRAMS, [c[3] for c in chunks], np.float64)
        for i, j, first, found, rank in chunks:
            scored[i:j] = np.add.reduceat(logs[np.searchsorted(grams, found)][rank], first)
        chunks = [(i, j, text, *ranked(hashes)) for i, j, hashes, text in word_chunks(data, offsets)]
        words, counts = answered(WORDS, [c[3] for c in chunks], np.int64)
        base = np.log10((counts + ALPHA) / (n + ALPHA * (v + 1)))
        for i, j, text, found, rank in chunks:
            at = np.searchsorted(words, found)
            tokens[i:j] = np.bincount(text, minlength=j - i)
            known[i:j] = np.bincount(text, (counts[at] > 0)[rank], j - i)
            based[i:j] = np.bincount(text, base[at][rank], j - i)
        return pa.table({
            "doc_id": texts["doc_id"].cast(pa.int64()), "held_out": texts["held_out"],
            "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": np.full(len(held), n, np.int64),
            "base_score": based, "score": scored, "n_bytes": np.diff(offsets),
        })

    return by_block.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
