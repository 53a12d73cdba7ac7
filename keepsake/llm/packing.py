"""Tokenised documents packed into sequences: large items matched, small ones best-fit into the gaps.

A document is its token ids and an end id. Longer ones than a sequence are cut into full pieces and
a rest. What a packing needs to know of a piece is its length, and lengths are few: so the packing
is planned on the number of pieces of each length, a table of at most ``capacity`` rows however many
documents there are. ``matched`` opens sequences for pieces above a third of the capacity, longest
first, each joining the fullest sequence of one piece that it fits into, so that no sequence has more
than two of them. ``filled`` then puts smaller ones, longest first, into the smallest gaps that take
them and opens a sequence where there is none. A step of the plan treats all sequences with one gap
alike, so the plan is some ten thousand steps at most; its gap falls by half or more at every step.

Every piece has a rank among those of its length: its place in one of the buckets that the pieces
were dealt to at random when they were written, after the pieces of the buckets before. The step of
the plan that holds the rank says sequence and place. No length, bucket or document, hot or not, is
one task.

Words repeat, so a task tokenises each distinct word only once (``by_word``). That is right for the named
tokenizer, which lets no token cross white space, and cuts words of ASCII and Latin letters into runs of
letters, single digits and runs of marks before its model sees them, lower-cased and byte by byte; words with
other characters, apostrophes or bars go through it whole.
For other tokenizers, ``by_word=False`` tokenises text by text.

Defined cases: a null or empty text is the end id alone; null and repeated ids are packed each; long
texts are cut, never dropped; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepsake.llm import textblocks as tb
from keepsake.session import settle

CAPACITY, END_ID = 2048, 0
BUCKET_ROWS = 250_000
CHUNK, BATCH_TOKENS, KNOWN_UNITS, AT_ONCE = 1 << 20, 4 << 20, 200_000, 4096



# Bytes of a word: 0 letters, 1 digits, 2 other plain marks; 3 whatever only the tokenizer itself may cut.
# Latin letters of two bytes, U+00C0 to U+024F, are letters like those of ASCII; see ``hard_bytes``.
KIND = np.array([
    0 if 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC9 else 3 if not 0x21 <= b <= 0x7E or chr(b) in "'|" else 0 if chr(b).isalpha() else 1 if chr(b).isdigit() else 2
    for b in range(256)], np.uint8)
# The two signs among them that are no letters, and the letter whose lower case is two characters.
NOT_PLAIN = "\u00d7\u00f7\u0130"


def hard_bytes(data: np.ndarray) -> np.ndarray:
    """Where bytes stand that are neither plain ASCII nor part of a plain Latin letter."""
    lead = (data >= 0xC3) & (data <= 0xC9)
    follows = np.zeros(len(data), bool)
    follows[:-1] = (data[1:] >= 0x80) & (data[1:] <= np.where(data[:-1] == 0xC9, 0x8F, 0xBF))
    pair = lead & follows
    for sign in NOT_PLAIN:
        first, second = sign.encode()
        pair[:-1] &= ~((data[:-1] == first) & (data[1:] == second))
    plain = pair.copy()
    plain[1:] |= pair[:-1]
    return (KIND[data] == 3) | ((data >= 0x80) & ~plain)


def byte_letters() -> list[str]:
    """The characters that stand for bytes in the vocabulary: visible ones themselves, the rest from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


# The same as code points; the end of a line stays, as it stands between units.
LETTERS = np.array([0x0A if b == 0x0A else ord(c) for b, c in enumerate(byte_letters())], "<u4")
TOKEN_ID = attrgetter("id")


class Units:
    """Token ids of units, each tokenised once; the memory is emptied when it holds too many.

    A unit is a word, or, where a word is plain, the run of letters, the digit or the run of
    marks that the tokenizer would cut it into, which then only needs its model.
    """

    def __init__(self, model: str):
        # a task has one core; threads of its own would take those of other tasks, and memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.place: dict[bytes, int] = {}
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, units: list[bytes]) -> Iterator[list[int]]:
        # all in lower case, and as the letters of their bytes, at once: no unit has white space, and no plain
        # letter's lower case depends on its neighbours
        lower = b"\n".join(units).decode().lower().encode()
        texts = LETTERS[np.frombuffer(lower, np.uint8)].tobytes().decode("utf-32-le").split("\n") if units else []
        tokenize = self.model.tokenize
        return (list(map(TOKEN_ID, tokenize(x))) for x in texts)

    def places(self, units: list[bytes]) -> np.ndarray:
        """The number of each of different units; new ones are tokenised."""
        found = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        fresh = np.flatnonzero(found < 0)
        if len(self.place) + len(fresh) > KNOWN_UNITS and self.place:
            self.place, fresh = {}, np.arange(len(units))
            self.start, self.length, self.ids = self.start[:0], self.length[:0], self.ids[:0]
        if len(fresh):
            found[fresh] = len(self.start) + np.arange(len(fresh))
            self.learn([units[k] for k in fresh.tolist()])
        return found

    def learn(self, new: list[bytes]) -> None:
        lengths, flat = [], []
        for k in range(0, len(new), AT_ONCE):
            some = new[k:k + AT_ONCE]
            at = np.cumsum([0, *map(len, some)])
            counted = np.concatenate(([0], np.cumsum(hard_bytes(np.frombuffer(b"".join(some), np.uint8)))))[at]
            whole = (counted[1:] > counted[:-1]).tolist()
            found = iter(self.encode([u.decode("utf-8", "replace") for u, w in zip(some, whole) if w]))
            cut = self.plain([u for u, w in zip(some, whole) if not w])
            ids = [next(found) if w else next(cut) for w in whole]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
        length = np.concatenate(lengths)
        self.place.update(zip(new, range(len(self.start), len(self.start) + len(new))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, *flat])


def runs_of(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of all texts in order, and the text of each."""
    first, last, owner = tb.words(data, offsets, tb.SOLID)
    hard = np.concatenate(([0], np.cumsum(hard_bytes(data))))
    plain = np.repeat(hard[last] == hard[first], last - first)
    inside = tb.SOLID[data]
    body = data[inside]
    kind = KIND[body]
    begins = np.zeros(len(body), bool)
    size = last - first
    begins[np.cumsum(size) - size] = True
    begins[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 1))
    at = np.flatnonzero(begins)
    body = np.where(plain, tb.LOWER[body], body)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(body))), pa.py_buffer(body)])
    return units.dictionary_encode(), np.repeat(owner, size)[at]


def values_of(words: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls, cut from its bytes at once."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


def tokens_by_word(known: Units, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with the end id, and their offsets."""
    units, owner = units_of(data, offsets)
    number = known.places(values_of(units.dictionary))
    found = units.indices.to_numpy()
    length = known.length[number][found]
    n = len(offsets) - 1
    per_text = np.bincount(owner, weights=length, minlength=n).astype(np.int64) + 1
    ends = np.cumsum(per_text)
    out = np.full(ends[-1] if n else 0, end, np.uint32)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = known.ids[runs_of(known.start[number][found], length)]
    return out, np.concatenate(([0], ends))


def tokens_by_text(known: Units, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    at, found = offsets.tolist(), []
    for a, b in zip(at, at[1:]):
        found.append([*known.encode([data[a:b].tobytes().decode("utf-8", "replace")])[0], end])
    length = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum())), np.concatenate(([0], np.cumsum(length)))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID, by_word: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids`` (unsigned little-endian 32-bit ids).

    ``tokenizer`` is a file of the driver; its content, a vocabulary of fixed size, goes to the tasks.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        known = Units(model.value)
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            for i, j in tb.chunks(offsets, CHUNK):
                ids, at = (tokens_by_word if by_word else tokens_by_text)(known, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], end)
                size = np.diff(at)
                parts = -(-size // capacity)
                piece = runs_of(np.zeros(len(parts), np.int64), parts)
                text = np.repeat(np.arange(i, j), parts)
                start = piece * capacity
                length = np.minimum(np.repeat(size, parts) - start, capacity)
                ids = ids.astype("<u4", copy=False)
                place = np.concatenate(([0], np.cumsum(length)))
                a = 0
                while a < len(length):
                    b = max(a + 1, int(np.searchsorted(place, place[a] + BATCH_TOKENS, "right")) - 1)
                    spans = ((place[a:b + 1] - place[a]) * 4).astype(np.int32)
                    values = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(spans), pa.py_buffer(ids[place[a]:place[b]])])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text[a:b])), pa.array(piece[a:b], pa.int32()), pa.array(start[a:b]), pa.array(length[a:b]), values], schema=schema)
                    a = b
        # workers serve many tasks: what this one needed is given back
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


class Plan:
    """Sequences of equal gap as (first number, how many), and the steps that filled them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.placed = np.zeros(capacity + 1, np.int64)

    def put(self, length: int, pieces: int, first: int, bins: int, gap: int, each: int) -> None:
        """Put up to ``each`` pieces of a length into every one of ``bins`` sequences, the last maybe fewer."""
        self.steps.append((length, int(self.placed[length]), pieces, first, each, self.capacity - gap))
        self.placed[length] += pieces
        full, rest = divmod(pieces, each)
        for number, count, taken in ((first, full, each), (first + full, min(rest, 1), rest), (first + full + min(rest, 1), bins - full - min(rest, 1), 0)):
            if count and gap > taken * length:
                self.open[gap - taken * length].append((number, count))

    def fresh(self, length: int, pieces: int, each: int) -> None:
        bins = -(-pieces // each)
        self.put(length, pieces, self.sequences, bins, self.capacity, each)
        self.sequences += bins

    def join(self, length: int, pieces: int, most: int, once: set | None = None) -> int:
        """Fill the smallest gaps that take the length; what is left over is returned."""
        for gap in range(length, self.capacity + 1):
            kept = []
            while self.open[gap] and pieces:
                first, bins = self.open[gap].pop()
                if once is not None and first not in once:
                    kept.append((first, bins))
                    continue
                each = min(most, gap // length)
                now = min(pieces, bins * each)
                used = -(-now // each)
                if once is not None:
                    once.discard(first)
                    if used < bins:
                        once.add(first + used)
                self.put(length, now, first, bins, gap, each)
                pieces -= now
            self.open[gap] += kept
            if not pieces:
                break
        return pieces


def matched(plan: Plan, counts: np.ndarray) -> None:
    """Pieces above a third of the capacity: at most two in a sequence, the longest first."""
    single: set[int] = set()
    for length in range(plan.capacity, plan.capacity // 3, -1):
        left = plan.join(length, int(counts[length]), 1, single)
        if left:
            each = min(2, plan.capacity // length)
            if each == 1 or left == 1:
                single.add(plan.sequences)
            elif left % 2:
                single.add(plan.sequences + left // 2)
            plan.fresh(length, left, each)


def filled(plan: Plan, counts: np.ndarray) -> None:
    """Smaller pieces, the longest first, each where it leaves the least room."""
    for length in range(plan.capacity // 3, 0, -1):
        left = plan.join(length, int(counts[length]), plan.capacity)
        if left:
            plan.fresh(length, left, plan.capacity // length)


def planned(counts: np.ndarray, capacity: int) -> Plan:
    plan = Plan(capacity)
    matched(plan, counts)
    filled(plan, counts)
    return plan


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of any columns with ``sequence_id`` and ``offset`` by their ``length`` (1 to the capacity)."""
    spark = pieces.sparkSession
    rows = settle(pieces.withColumn("_u", F.rand(13)), "pieces")
    found = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["n"]
    plan = planned(counts, capacity)
    buckets = max(1, -(-int(counts.sum()) // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shares = shares.select("length", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    # at most ``capacity`` rows with some ten thousand steps in all: bounded whatever the input
    steps: dict[int, list[tuple]] = {}
    for length, *step in plan.steps:
        steps.setdefault(length, []).append(tuple(step))
    table = spark.createDataFrame(
        list(steps.items()), "length long, _steps array<struct<first:long,pieces:long,sequence:long,each:long,used:long>>")
    own = Window.partitionBy("length", "_bucket").orderBy("_u")
    ranked = rows.join(settle(shares, "shares"), ["length", "_bucket"]).withColumn("_rank", F.row_number().over(own) - 1 + F.col("_before"))
    step = F.element_at(F.filter("_steps", lambda s: s["first"] <= F.col("_rank")), -1)
    chosen = ranked.join(F.broadcast(table), "length").withColumn("_step", step).withColumn("_i", F.col("_rank") - F.col("_step.first"))
    return chosen.select(
        *pieces.columns, (F.col("_step.sequence") + F.expr("_i div _step.each")).alias("sequence_id"),
        (F.col("_step.used") + F.col("_i") % F.col("_step.each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: ``sequence_id, ids, parts`` with the documents and their places in it."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["length"].alias("length"))).alias("parts"),
    )
