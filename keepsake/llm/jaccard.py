"""Documents linked by the Jaccard similarity of their word shingles: adaptive multi-match prefixes.

Shingles are ordered by rarity (``frequencies``), then by hash. If two sets of n and m shingles
reach the similarity t, the first n - ceil(t n) + L and m - ceil(t m) + L of them share L
shingles, for any L up to the overlap. Each document takes the L of least estimated cost: the
shingles it sends, and the partners their frequencies promise divided by L. A pair is a
candidate if its prefixes share as many shingles as the smaller L of the two, and its sizes
allow the similarity, and what they share in the prefixes together with all that follows the
longer rest could still reach it. Bitmaps of ``64 * SKETCH`` marks rule out pairs that lack
too many of each other's marks. Candidates are verified on their whole sets.

Equal sets are one class from the start (its key is a 64-bit sum over the set), so copies never
meet in pairs. Linked classes are joined in rounds. In each of the first, in the lists of every
eighth shared shingle (others each time), all classes are compared with the first and the last
of the list (in another order each time), unless their labels say that they hang together: a
large group of near copies grows together by a few links each. Labels are spread along a round's
links by two steps; where they differ they say nothing, so that only the end asks for exact
components. The rounds end when one finds few links. Then all lists are taken, but only pairs
whose ends still have different labels are candidates; they are the only ones that can change
the result. Long lists meet block by block, so no task holds a whole one. Nothing is
left out, and a group is not expanded into its pairs. A pair that was found not similar is
no candidate again.

Texts stay where the documents are: each check reads the documents and shuffles only those
that ``MARKS`` bits, set by the ids of the candidates' documents, let through. Their number is
fixed, so with very many candidates more texts travel than are needed; the result is the same.

Prefixes travel packed, a list per task and bucket. The frequency table has ``COUNTERS``
entries, whatever the input: shingles share entries, so it tells common passages from the
rest, and decides cost, never the result. Shingles are compared as 64-bit hashes.

Defined cases: null, empty or blank texts have no shingles and are linked with nothing; fewer
than ``width`` words are one shingle. Rows that share an id are one document for links. Rows
without an id get the component of equal sets with an id, else null. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import textblocks as tb
from keepsake.llm.common import blocks_for, bytes_of, summed_slices, unused
from keepsake.llm.components import components
from keepsake.session import settle

WIDTH = 5
PERCENT = 75
BUCKET_BYTES = 8 << 20
COUNTERS = 1 << 20
SLICES = 64
FLUSH = 1 << 20
MOST = 3
ANCHOR = 8
ROUNDS = 4
FEW = 128
SKETCH = 16
BLOCK = 2048
PART_ROWS = 1 << 16
PAIRS = 1 << 17
MARKS = 1 << 24
SETS = "doc_id long, content long, n long, cls long, bits array<long>, slice int, part int, counters binary"


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, with the text number, sorted by text and hash."""
    start, end, owner = tb.words(data, offsets, tb.SOLID)
    hashes = tb.span_hashes(data, start, end)
    full = tb.window_hashes(hashes, width)
    first = np.flatnonzero(owner[:len(full)] == owner[width - 1:len(full) + width - 1]) if len(full) else np.zeros(0, np.int64)
    found, texts = [full[first]], [owner[first]]
    n = np.bincount(owner, minlength=len(offsets) - 1)
    at = np.cumsum(n) - n
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            found.append(tb.window_hashes(hashes, k)[at[short]])
            texts.append(short)
    found, texts = np.concatenate(found), np.concatenate(texts)
    order = np.lexsort((found, texts))
    found, texts = found[order], texts[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (texts[1:] != texts[:-1])
    return found[new], texts[new]


def sets_of(column, width: int):
    """Chunks of a batch: first and last text, shingles, text of each, size and class of each text."""
    data, offsets = tb.utf8(column)
    data = tb.LOWER[data]
    for i, j in tb.chunks(offsets):
        found, texts = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
        sizes = np.bincount(texts, minlength=j - i)
        classes = np.zeros(j - i, np.uint64)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes) - sizes
            classes[some] = tb.mix(np.add.reduceat(tb.mix(found), starts[some]) + sizes[some].astype(np.uint64))
        yield i, j, found, texts, sizes, classes


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Size and class of every document, and the frequency counters of every task in slices."""

    def run(batches):
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, classes, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, found, texts, size, cls in sets_of(batch.column(2), width):
                marks = np.zeros((len(size), SKETCH * 64), bool)
                marks[texts, ((found >> np.uint64(32)) % np.uint64(SKETCH * 64)).astype(np.int64)] = True
                bits.append(np.packbits(marks, axis=1).view(np.int64).reshape(-1))
                counters += np.bincount((found % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                sizes.append(size)
                classes.append(cls)
            sizes, classes = np.concatenate(sizes), np.concatenate(classes).view(np.int64)
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, mask=sizes == 0),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * SKETCH, pa.int32()), pa.array(np.concatenate(bits), pa.int64())),
                none, none, pa.nulls(len(sizes), pa.binary()),
            ], names=["doc_id", "content", "n", "cls", "bits", "slice", "part", "counters"])
        parts = np.array_split(counters.astype(np.uint32), SLICES)
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([
            none, none, none, none, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()),
            pa.array([TaskContext.get().partitionId() % 256] * SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
        ], names=["doc_id", "content", "n", "cls", "bits", "slice", "part", "counters"])

    return settle(docs.mapInArrow(run, SETS), "shingle-sets")


def frequencies(described: DataFrame) -> np.ndarray:
    """Sum of all tasks' counters, less what chance puts into one."""

    rows = described.filter("slice is not null").select("slice", "part", "counters")
    slices = {k: np.frombuffer(v, np.int64) for k, v in summed_slices(rows, "uint32").items()}
    if not slices:
        return np.ones(COUNTERS, np.uint32)
    counts = np.concatenate([slices[i] for i in range(SLICES)]).astype(np.float64)
    usual = np.median(counts)
    return np.minimum(np.maximum(counts - usual - 4 * np.sqrt(usual), 1), np.iinfo(np.uint32).max).astype(np.uint32)


def prefixes(found, texts, sizes, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles are sent, the text of each, and the matches each text asks for."""
    common = often[(found % np.uint64(COUNTERS)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((found, np.frexp(common.astype(np.float64))[1], texts))
    found, common = found[order], common[order] - 1
    starts = np.cumsum(sizes) - sizes
    must = -(-percent * sizes // 100)
    partners = np.concatenate(([0], np.cumsum(common)))
    ask, least = np.ones(len(sizes), np.int64), None
    for k in range(1, MOST + 1):
        take = np.minimum(sizes - must + k, sizes)
        cost = take + (partners[starts + take] - partners[starts]) / k
        if least is None:
            least = cost
        better = (cost < least) & (must >= k)
        ask[better], least = k, np.where(better, cost, least)
    take = np.minimum(sizes - must + ask, sizes)
    sent = np.arange(len(found)) - starts[texts] < take[texts]
    return found[sent], texts[sent], ask


def shared_prefixes(docs: DataFrame, often: np.ndarray, buckets: int, width: int, percent: int) -> DataFrame:
    """``token, cls, ask`` of every prefix shingle that two classes or more have."""

    def pack(found, classes, ask):
        pairs = np.unique(np.rec.fromarrays([found, classes, ask]))
        found, classes, ask = pairs.f0, pairs.f1, pairs.f2
        bucket = (found % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        there, at = np.unique(bucket[order], return_index=True)
        found, classes, ask = found[order], classes[order], ask[order]
        at = np.append(at, len(found))
        cut = [slice(i, j) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([
            pa.array(there, pa.int32()), pa.array([np.ascontiguousarray(found[c]).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for c in cut], pa.binary()),
            pa.array([classes[c].tobytes() for c in cut], pa.binary()), pa.array([ask[c].tobytes() for c in cut], pa.binary()),
        ], ["bucket", "tokens", "classes", "asks"])

    def send(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, found, texts, sizes, classes in sets_of(batch.column(0), width):
                token, text, ask = prefixes(found, texts, sizes, often, percent)
                held.append((token, classes[text], ask[text].astype(np.uint8)))
                size += len(token)
                if size >= FLUSH:
                    yield from pack(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield from pack(*(np.concatenate(x) for x in zip(*held)))

    def meet(key, table):
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table["tokens"].to_pylist()]
        wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
        wide[:, 2:] = np.concatenate(parts)
        token = wide.reshape(-1).view(np.uint64)
        cls = np.concatenate([np.frombuffer(x, np.uint64) for x in table["classes"].to_pylist()])
        ask = np.concatenate([np.frombuffer(x, np.uint8) for x in table["asks"].to_pylist()])
        order = np.lexsort((cls, token))
        token, cls, ask = token[order], cls[order], ask[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, ask = token[new], cls[new], ask[new]
        near = np.zeros(len(token) + 1, bool)
        near[1:-1] = token[1:] == token[:-1]
        keep = near[1:] | near[:-1]
        # buckets keep apart tokens whose six bytes agree
        token = token[keep] + np.uint64(key[0].as_py() % (1 << 16))
        return pa.table({"token": token.view(np.int64), "cls": cls[keep].view(np.int64), "ask": ask[keep].astype(np.int32)})

    sent = docs.select("text").mapInArrow(send, "bucket int, tokens binary, classes binary, asks binary")
    return sent.groupBy("bucket").applyInArrow(meet, "token long, cls long, ask int")


def marked(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """Documents with the ids of ``ends``, and few others: bits of a fixed number go to all tasks, in words of 64."""
    place, bit = f"pmod(xxhash64(doc_id), {MARKS}L)", "cast(place & 63 as int)"
    words = ends.select(F.expr(place).alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("marks"))
    placed = docs.withColumn("place", F.expr(place))
    return placed.join(F.broadcast(words), F.expr(f"word = shiftright(place, 6) and getbit(marks, {bit}) = 1"), "left_semi").drop("place")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs ``a, b`` (classes) and their other columns, and whether they are ``similar`` enough.

    ``classes(cls, doc_id, content)`` tells the document of a class. ``pairs`` and ``docs`` are read more than once.
    """
    names = pairs.columns

    def check(batches):
        for batch in batches:
            rows = []
            for column in (-2, -1):
                sets = []
                for i, j, found, owner, sizes, _ in sets_of(batch.column(column), width):
                    sets += np.split(found, np.cumsum(sizes)[:-1])
                rows.append(sets)
            good = []
            for x, y in zip(*rows):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(names).append_column("similar", pa.array(good, pa.bool_()))

    keys = classes.select("cls", "doc_id", "content")
    near = marked(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(keys, "cls"))
    joined = pairs.join(keys.toDF("a", "id_a", "content_a"), "a").join(keys.toDF("b", "id_b", "content_b"), "b")
    for end in "ab":
        text = near.select(F.col("doc_id").alias(f"id_{end}"), F.col("content").alias(f"content_{end}"), F.col("text").alias(f"text_{end}"))
        joined = joined.join(text, [f"id_{end}", f"content_{end}"])
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in pairs.schema)
    return joined.select(*names, "text_a", "text_b").mapInArrow(check, f"{kinds}, similar boolean")


def alike(n: str, m: str, percent: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def in_parts(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of the lists that reach across components, dealt to parts.

    A list of k classes falls into blocks of about ``BLOCK``, a power of two of them, and each two blocks
    meet in one part. Lists with the same lowest component lie together, up to ``PART_ROWS`` rows,
    as they are likely to hold the same pairs.
    """
    lists = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")).filter("lo < hi")
    lists = settle(lists.withColumn("m", F.expr(f"cast(power(2, ceil(log2(greatest(1, k / {BLOCK})))) as int)")).select("token", "lo", "k", "m"), "open-lists")
    weights = lists.groupBy("lo").agg(F.ceil(F.sum(F.col("k") * F.col("m")) / PART_ROWS).alias("salts"))
    lists = lists.join(weights, "lo").withColumn("place", F.xxhash64("lo", F.pmod(F.xxhash64("token"), "salts"))).select("token", "m", "place")
    met = rows.join(lists, "token").withColumn("block", F.pmod(F.xxhash64("cls"), "m").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return met.withColumn("part", F.pmod(F.xxhash64("place", "low", "high"), F.lit(buckets)).cast("int")).select(
        "part", "token", "low", "high", "block", "cls", "n", "ask", "component")


def across_components(dealt: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a, b`` whose ends are in different components, by prefixes, sizes and bitmaps."""

    def summed(parts):
        a, b, shared, ask, beyond, need = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else order
        counts = np.add.reduceat(shared[order], new) if len(a) else shared
        first = order[new]
        return a[new], b[new], counts, ask[first], beyond[first], need[first]

    def meet(table):
        col = {c: table[c].to_numpy() for c in ("token", "low", "high", "block", "cls", "n", "ask", "component")}
        order = np.lexsort((col["cls"], col["high"], col["low"], col["token"]))
        marks = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)[order].T.copy()
        col = {c: v[order] for c, v in col.items()}
        token, low, high, block, cls, n, ask, component = col.values()
        n, ask = n.astype(np.int64), ask.astype(np.int64)
        begins = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        ends = np.repeat(np.append(begins[1:], len(token)), np.diff(np.append(begins, len(token))))
        after = ends - np.arange(len(token)) - 1
        upto = np.concatenate(([0], np.cumsum(after)))
        held, size = [tuple(np.zeros(0, np.int64) for _ in range(6))], 0
        row = 0
        while row < len(token):
            last = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(row, last), after[row:last])
            y = np.arange(len(x)) - (upto[x] - upto[row]) + x + 1
            row = last
            some = (component[x] != component[y]) & ((low[x] == high[x]) | (block[x] != block[y]))
            some &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[some], y[some]
            need = -(-(n[x] + n[y]) * percent // (100 + percent))
            spare_x, spare_y = n[x] - need, n[y] - need
            for word in marks:
                u, v = word[x], word[y]
                spare_x -= np.bitwise_count(u & ~v)
                spare_y -= np.bitwise_count(v & ~u)
            good = (spare_x >= 0) & (spare_y >= 0)
            x, y, need = x[good], y[good], need[good]
            beyond = -(-percent * n // 100) - ask
            held.append((cls[x], cls[y], np.ones(len(x), np.int64), np.minimum(ask[x], ask[y]), np.maximum(beyond[x], beyond[y]), need))
            size += len(x)
            if size > 4 * PAIRS:
                held, size = [summed(held)], 0
        return pa.table(dict(zip(("a", "b", "shared", "ask", "beyond", "need"), summed(held))))

    pairs = dealt.groupBy("part").applyInArrow(meet, "a long, b long, shared long, ask long, beyond long, need long")
    return pairs.groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.min("ask").alias("ask"), F.max("beyond").alias("beyond"), F.max("need").alias("need"),
    ).filter("shared >= ask and shared + beyond >= need").select("a", "b")


def star_pairs(rows: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs of a class and the ends of its lists, in an order of classes of this round's own, with their different labels."""
    taken = rows.filter(F.pmod(F.xxhash64("token", F.lit(number)), F.lit(ANCHOR)) == 0)
    me = F.struct(F.xxhash64("cls", F.lit(number)).alias("place"), "cls", "n", "component")
    lists = taken.groupBy("token").agg(
        F.min(me).alias("low"), F.max(me).alias("high"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).filter("lo < hi").select("token", "low", "high")
    met = taken.join(lists, "token").select("token", "cls", "n", "component", F.explode(F.array_distinct(F.array("low", "high"))).alias("e"))
    met = met.filter("e.component <> component").filter(alike("n", "e.n", percent)).groupBy(
        F.least("cls", "e.cls").alias("a"), F.greatest("cls", "e.cls").alias("b"),
        F.least("component", "e.component").alias("la"), F.greatest("component", "e.component").alias("lb")).agg(
        F.count_distinct("token").alias("met"), F.min(F.least("n", "e.n")).alias("n"))
    # a guess from the lists taken; what it leaves out is left to the last round
    return met.filter(2 * ANCHOR * (100 + percent) * F.col("met") >= (100 - percent) * percent * F.col("n") / 100).select("a", "b", "la", "lb")


def spread(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``cls, n, component``: each label becomes the lowest one at most two links ``la, lb`` away.

    Equal labels are of classes that hang together, whatever the number of steps.
    """
    sides = found.select(F.col("la").alias("x"), F.col("lb").alias("y")).union(found.select("lb", "la"))
    near = sides.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
    far = sides.join(near.withColumnRenamed("x", "y"), "y").groupBy(F.col("x").alias("component")).agg(F.min("m").alias("m"))
    return labels.join(far, "component", "left").select("cls", "n", F.coalesce("m", "component").alias("component"))


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; links are pairs of ``percent`` or more.

    ``docs`` is read again in each round, so it should be a table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    buckets = max(16, blocks_for(bytes_of(docs), bucket_bytes))
    described = describe(docs, width)
    sets = described.filter("slice is null").select("doc_id", "content", "n", "cls", "bits")
    often = frequencies(described)
    shared = settle(shared_prefixes(docs, often, buckets, width, percent), "shared-prefixes")
    classes = sets.filter("cls is not null").groupBy("cls").agg(
        F.min_by(F.struct("doc_id", "content"), F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "content"))).alias("first"), F.max("n").alias("n"), F.first("bits").alias("bits"),
    )
    classes = settle(
        classes.join(shared.select("cls").distinct(), "cls", "left_semi").filter("first is not null").select("cls", "first.*", "n", "bits"), "classes",
    )
    # each round goes on from the labels of the one before, and one that finds few links ends them
    labels = classes.select("cls", "n", F.col("cls").alias("component"))
    links, failed, total = [], [], 0

    def untried(pairs):
        return pairs.join(reduce(DataFrame.union, failed), ["a", "b"], "left_anti") if failed else pairs

    for r in range(ROUNDS):
        star = settle(untried(star_pairs(shared.join(labels, "cls"), r, percent)), "star")
        judged = settle(verified(star, classes, docs, width, percent), "links")
        found = judged.filter("similar")
        failed.append(judged.filter("not similar").select("a", "b"))
        links.append(found.select("a", "b"))
        count = found.count()
        if FEW * count <= total:
            break
        total += count
        labels = settle(spread(labels, found), "labels")

    parted = shared.join(labels, "cls").select("token", "cls", "n", "ask", "component")
    dealt = in_parts(settle(parted, "marked"), buckets).join(classes.select("cls", "bits"), "cls")
    pairs = settle(untried(across_components(dealt, percent)), "pairs")
    links.append(verified(pairs, classes, docs, width, percent).filter("similar").select("a", "b"))

    ids = classes.select("cls", "doc_id")
    links = reduce(DataFrame.union, links).join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # ids of one class and rows of one id hang together too
    lowest = sets.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    own = sets.filter("cls is not null").join(lowest, "cls").select("doc_id", "n", "low")
    twice = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("low").alias("lo"), F.max("low").alias("hi")).filter("lo < hi")
    links = links.union(twice.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    final = components(links)
    alone = sets.filter("cls is null").select("doc_id", "n", F.col("doc_id").alias("low"))
    return own.union(alone).join(final, F.col("low") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "low").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without shingles or id stay.

    Where an id repeats, equal texts of it are one document and different ones stay each.
    """
    docs = settle(docs, "linked-docs")
    linked = settle(link(docs, width, percent), "linked")
    other = unused(docs.columns, "other")
    gone = settle(linked.filter("component_id <> doc_id").select(F.col("doc_id").alias(other)).distinct(), "gone")
    twice = settle(linked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(other)), "twice")
    repeated = (F.col("doc_id").cast("long") == F.col(other)) & F.col("text").isNotNull()
    kept = docs.join(gone, repeated, "left_anti")
    return kept.join(twice, repeated, "left_anti").unionByName(kept.join(twice, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
