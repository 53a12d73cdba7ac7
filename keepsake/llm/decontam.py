"""Benchmark passages in documents, by a prefix-filtered containment join.

An item's windows are its runs of ``width`` words (a shorter item is one window). A document
contains a window when the words stand there in order, so one word of the window is enough as
its prefix: the one that is rarest over all documents. A word of a document meets only the
windows it is the prefix of, at a known offset; the length bound (the window must fit between
the ends of the document) and the positional bound (the start that the offset gives) leave one
place per candidate, where the words are compared one by one, as 64-bit hashes.

The windows of a block of items (``ITEM_BYTES`` of text, by hash of the id) are sent to all
tasks; a larger benchmark is more blocks, one pass over the documents each, so what is sent
never grows with either table. Only hits are shuffled.

Defined cases: null or empty texts have no words and contain nothing; an item without words
occurs nowhere; repeated items with one id count once; repeated documents are judged each.
Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import textblocks as tb
from keepsake.llm.common import block_of, blocks_for, bytes_of, unused
from keepsake.session import settle

WIDTH = 10
ITEM_BYTES = 4 << 20
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def item_windows(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, length and item number of every window; short windows are padded with 0."""
    data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
    data = tb.LOWER[data]
    start, end, owner = tb.words(data, offsets, tb.ALNUM)
    hashes = tb.span_hashes(data, start, end)
    rows, sizes, items = [np.zeros((0, width), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b - a >= width:
            found = np.lib.stride_tricks.sliding_window_view(hashes[a:b], width)
        elif b > a:
            found = np.pad(hashes[a:b], (0, width - (b - a)))[None, :]
        else:
            continue
        rows.append(found)
        sizes.append(np.full(len(found), min(b - a, width)))
        items.append(np.full(len(found), i))
    return np.concatenate(rows), np.concatenate(sizes), np.concatenate(items)


def document_words(batch_column):
    """Chunks of a batch: first text, word hashes, and the text of each word."""
    data, offsets = tb.utf8(batch_column)
    data = tb.LOWER[data]
    for i, j in tb.chunks(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        start, end, owner = tb.words(part, at, tb.ALNUM)
        yield i, j, tb.span_hashes(part, start, end), owner


def placed(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in sorted ``values`` of each wanted value, and whether it is there."""
    at = np.minimum(np.searchsorted(values, wanted), max(0, len(values) - 1))
    return at, values[at] == wanted if len(values) else np.zeros(len(wanted), bool)


def filter_bits(values: np.ndarray) -> np.ndarray:
    """Which low 20 bits occur: most words are ruled out by one lookup."""
    bits = np.zeros(1 << 20, bool)
    bits[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def among(values: np.ndarray, bits: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``wanted`` of members of the sorted ``values``, and which member each is."""
    maybe = np.flatnonzero(bits[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at, ok = placed(values, wanted[maybe])
    return maybe[ok], at[ok]


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences over all documents of the words of one block of items."""
    bits = filter_bits(vocabulary)

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, hashes, _ in document_words(batch.column(0)):
                _, which = among(vocabulary, bits, hashes)
                total += np.bincount(which, minlength=len(vocabulary))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for word, n in docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[word] = n
    return out


def occurrences(docs: DataFrame, items: list, width: int) -> DataFrame:
    """Documents holding windows of these items: word ranges hit, and the ids of the items."""
    ids = [r[0] for r in items]
    windows, sizes, owner = item_windows([r[1] for r in items], width)
    vocabulary = np.unique(windows[np.arange(width)[None, :] < sizes[:, None]])
    counts = word_counts(docs, vocabulary) if len(vocabulary) else np.zeros(0, np.int64)

    inside = np.arange(width)[None, :] < sizes[:, None]
    rarity = np.where(inside, counts[placed(vocabulary, windows)[0]] if len(vocabulary) else 0, np.iinfo(np.int64).max)
    offset = rarity.argmin(1) if len(windows) else np.zeros(0, np.int64)
    prefix = windows[np.arange(len(windows)), offset]
    order = np.argsort(prefix, kind="stable")
    windows, sizes, owner, offset, prefix = windows[order], sizes[order], owner[order], offset[order], prefix[order]
    tokens, first = np.unique(prefix, return_index=True)
    last = np.append(first[1:], len(prefix))
    bits = filter_bits(tokens)
    columns = np.arange(width)

    def search(batches):
        for batch in batches:
            at_doc, spans, found = [], [], []
            for i, j, hashes, text in document_words(batch.column(2)):
                where, token = among(tokens, bits, hashes)
                many = last[token] - first[token]
                window = np.repeat(first[token], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                where = np.repeat(where, many)
                begin = where - offset[window]
                bounds = np.searchsorted(text, np.arange(j - i + 1))
                own = text[where]
                fits = (begin >= bounds[own]) & (begin + sizes[window] <= bounds[own + 1])
                begin, window, own = begin[fits], window[fits], own[fits]
                reach = np.minimum(begin[:, None] + columns, len(hashes) - 1)
                same = (hashes[reach] == windows[window]) | (columns >= sizes[window][:, None])
                hit = same.all(1)
                begin, window, own = begin[hit], window[hit], own[hit]
                for d in np.unique(own):
                    mine = own == d
                    s = np.unique(begin[mine] - bounds[d])
                    e = np.array([(begin[mine] - bounds[d] + sizes[window[mine]])[begin[mine] - bounds[d] == x].max() for x in s])
                    at_doc.append(i + int(d))
                    spans.append([{"a": int(a), "b": int(b)} for a, b in zip(s, e)])
                    found.append([ids[x] for x in np.unique(owner[window[mine]])])
            rows = pa.array(at_doc, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows).cast(pa.int64()), batch.column(1).take(rows),
                pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(found, pa.list_(pa.int64())),
            ], ["doc_id", "content", "spans", "items"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(search, "doc_id long, content long, spans array<struct<a int, b int>>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per document: words, words inside any occurring window, and the sorted ids (text) of the items found.

    ``spans`` are the word ranges hit (start, end), in order.
    """
    n = blocks_for(bytes_of(benchmark), item_bytes)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", block_of(n, "item_id", "text").alias("block"))
    if n > 1:
        items = settle(items, "items")
    passes = [occurrences(docs, items.filter(F.col("block") == b).select("item_id", "text").collect(), width) for b in range(n)]
    hits = (
        reduce(DataFrame.unionByName, passes).groupBy(F.col("doc_id").alias("d"), F.col("content").alias("c"))
        .agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
             F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda i: i.cast("string")))).alias("items"))
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", start,
        lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], x["end"]))).alias("n"), F.greatest(x["end"], s["b"]).alias("end")),
        lambda x: x["n"],
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left").select(
        "doc_id", "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<a int, b int>>")).alias("spans"), "content",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    key, content = unused(docs.columns, "key"), unused(docs.columns, "content")
    found = contamination(docs, benchmark, width).filter("n_hit > 0").select(F.col("doc_id").alias(key), F.col("content").alias(content))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(content))
    return docs.join(found, same, "left_anti")
