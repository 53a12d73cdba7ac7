"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a public vocabulary that hold only letters (a-z and non-ASCII bytes,
at most ``LONGEST`` bytes), and every single byte, so each word has a segmentation. A word's
probability in a language is the sum over all its segmentations of the product of piece
probabilities, by the forward algorithm; a text's is the product over its words.

Piece probabilities come from one step of expectation maximisation over the training texts:
under evenly likely pieces, forward and backward sums give the expected number of uses of a
piece in each word; a task adds them up per language, and the sums over all tasks are the
model: pieces x languages, whatever the input. Distinct words of many texts are computed once.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text
when nothing was learned. Null languages are not learned from. ``score`` is the share of the best
language in the probabilities of all, languages being equally likely before. Ties go to the
language first by code point. Words are cut every ``PART`` bytes. Repeated rows are each scored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import textblocks as tb

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST = 10
PART = 32
KNOWN = 200_000
SCALE = 8.0
UNITS = 1000
SMOOTH = 0.05
LETTER = tb.table_of(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)
TEXT_CHUNK = 2 << 20


def pieces_of(path: str = VOCABULARY) -> list[bytes]:
    """Letter pieces of a rank file (base64 and rank per line), after all single bytes."""
    found = set()
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).lstrip(b" ").lower()
            if 1 < len(piece) <= LONGEST and LETTER[np.frombuffer(piece, np.uint8)].all():
                found.add(piece)
    return [bytes([b]) for b in range(256)] + sorted(found)


class Lattice:
    """All places where pieces fit into words, found by hash."""

    def __init__(self, pieces: list[bytes]):
        data, offsets = tb.utf8(pa.array(pieces, pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
        hashes = tb.span_hashes(data, offsets[:-1], offsets[1:])
        self.piece = np.argsort(hashes)
        self.hashes = hashes[self.piece]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = np.array([len(p) for p in pieces])
        self.size = len(pieces)

    def fits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and piece of each fit in words laid end to end, ordered by end within the word."""
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        begins, ends, pieces = [], [], []
        for n in range(1, LONGEST + 1):
            begin = np.arange(len(data) - n + 1)
            if n > 1:
                begin = begin[owner[:len(begin)] == owner[n - 1:]]
            h = tb.span_hashes(data, begin, begin + n)
            maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, h[maybe]), self.size - 1)
            ok = self.hashes[place] == h[maybe]
            begins.append(begin[maybe[ok]])
            ends.append(begin[maybe[ok]] + n)
            pieces.append(self.piece[place[ok]])
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        depth = end - at[owner[end - 1]]
        order = np.lexsort((end, depth))
        return begin[order], end[order], piece[order]

    def forward(self, data, at, weights: np.ndarray):
        """Scaled forward sums; slot ``position + word`` is the state before that byte of the word."""
        begin, end, piece = self.fits(data, at)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        source, target = begin + owner[begin], end + owner[begin]
        depth = end - at[owner[begin]]
        state = np.zeros((len(data) + len(at) - 1, weights.shape[1]))
        state[at[:-1] + np.arange(len(at) - 1)] = 1
        levels = np.searchsorted(depth, np.arange(1, (depth.max() if len(depth) else 0) + 2))
        for i, j in zip(levels[:-1], levels[1:]):
            if j > i:
                first = np.flatnonzero(np.concatenate(([True], target[i + 1:j] != target[i:j - 1])))
                state[target[i:j][first]] = np.add.reduceat(state[source[i:j]] * weights[piece[i:j]], first, axis=0)
        return state, source, target, piece, depth, owner[begin]

    def words(self, data, at, logs: np.ndarray) -> np.ndarray:
        """log probability of each word in each language."""
        weights = np.exp(logs) * SCALE ** self.lengths[:, None]
        state = self.forward(data, at, weights)[0]
        n = np.diff(at)
        return np.log(np.maximum(state[at[1:] + np.arange(len(n))], 1e-300)) - n[:, None] * np.log(SCALE)

    def uses(self, data, at, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece per language, pieces evenly likely; ``counts`` are words x languages."""
        weights = SCALE ** self.lengths[:, None] / self.size
        state, source, target, piece, depth, word = self.forward(data, at, weights)
        back = np.zeros(len(state))
        last = at[1:] + np.arange(len(at) - 1)
        back[last] = 1
        order = np.lexsort((source, source - (at[word] + word)))[::-1]
        s, t, p = source[order], target[order], piece[order]
        level = s - (at[word] + word)[order]
        cuts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1], [True]))) if len(level) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1], cuts[1:]):
            first = np.flatnonzero(np.concatenate(([True], s[i + 1:j] != s[i:j - 1])))
            back[s[i:j][first]] += np.add.reduceat(back[t[i:j]] * weights[p[i:j], 0], first)
        share = state[source, 0] * weights[piece, 0] * back[target] / np.maximum(state[last, 0], 1e-300)[word]
        return np.stack([np.bincount(piece, share * counts[word, k], self.size) for k in range(counts.shape[1])], 1)


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct words: hashes, bytes end to end with offsets; and for every word its number and text."""
    start, end, text = tb.words(data, offsets, LETTER)
    long_ = np.flatnonzero(end - start > PART)
    if len(long_):
        many = -(-(end - start)[long_] // PART)
        rest = np.setdiff1d(np.arange(len(start)), long_)
        step = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * PART
        s = np.repeat(start[long_], many) + step
        e = np.minimum(s + PART, np.repeat(end[long_], many))
        start, end, text = np.append(start[rest], s), np.append(end[rest], e), np.append(text[rest], np.repeat(text[long_], many))
    hashes, first, number = np.unique(tb.span_hashes(data, start, end), return_index=True, return_inverse=True)
    start, n = start[first], (end - start)[first]
    at = np.append(0, np.cumsum(n))
    return hashes, data[np.arange(at[-1]) + np.repeat(start - at[:-1], n)], at, number, text


def chunks_of(column):
    data, offsets = tb.utf8(column)
    data = tb.LOWER[data]
    for i, j in tb.chunks(offsets, TEXT_CHUNK):
        yield i, j, *distinct_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def gather(data, at, keep: np.ndarray):
    n = np.diff(at)[keep]
    to = np.append(0, np.cumsum(n))
    return data[np.arange(to[-1]) + np.repeat(at[:-1][keep] - to[:-1], n)], to


def learn(docs: DataFrame, pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (pieces x languages) from ``docs(lang, text)``."""

    def run(batches):
        lattice = Lattice(pieces)
        total: dict[str, np.ndarray] = {}
        held: list[tuple] = []

        def settle_words():
            langs = sorted({k for h in held for k in h[3]})
            hashes, first, number = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            counts = np.zeros((len(hashes), len(langs)))
            base = 0
            for h in held:
                for k, c in zip(h[3], h[4].T):
                    np.add.at(counts[:, langs.index(k)], number[base:base + len(h[0])], c)
                base += len(h[0])
            data = np.concatenate([h[1] for h in held])
            ends = np.cumsum([len(h[1]) for h in held])
            at = np.append(0, np.concatenate([h[2][1:] + e - len(h[1]) for h, e in zip(held, ends)]))
            data, at = gather(data, at, first)
            for i in range(0, len(first), 50_000):
                j = min(i + 50_000, len(first))
                uses = lattice.uses(data[at[i]:at[j]], at[i:j + 1] - at[i], counts[i:j])
                for k, name in enumerate(langs):
                    total[name] = total.get(name, 0) + uses[:, k]
            held.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for i, j, hashes, data, at, number, text in chunks_of(batch.column(1)):
                langs, which = np.unique(names[i:j].astype(str), return_inverse=True)
                counts = np.zeros((len(hashes), len(langs)))
                np.add.at(counts, (number, which[text]), 1)
                held.append((hashes, data, at, [str(x) for x in langs], counts))
                if sum(len(h[0]) for h in held) > KNOWN:
                    settle_words()
        if held:
            settle_words()
        for name, uses in total.items():
            units = np.rint(uses * UNITS).astype(np.int64)
            there = np.flatnonzero(units)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(units[there], pa.int64())], ["lang", "piece", "n"])

    summed = docs.select("lang", "text").mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((len(pieces), len(langs)))
    place = {k: i for i, k in enumerate(langs)}
    np.add.at(counts, (rows["piece"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)), rows["n"].to_numpy() / UNITS)
    counts += SMOOTH
    return langs, np.log(counts / counts.sum(0))


def identify(docs: DataFrame, learned: DataFrame, columns: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``docs``, ``lang_pred`` and ``score``, from the languages of ``learned(lang, text)``."""
    pieces = pieces_of(vocabulary)
    langs, logs = learn(learned.filter("lang is not null"), pieces)
    inputs = docs.select(*columns, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered"), F.col("text").alias("_text_read"))
    schema = inputs.drop("_lettered", "_text_read").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        lattice = Lattice(pieces)
        known, value = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(langs)))
            for i, j, hashes, data, at, number, text in chunks_of(batch.column(batch.num_columns - 1)) if langs else ():
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                there = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                new = np.flatnonzero(~there)
                logp = np.empty((len(hashes), len(langs)))
                if len(known):
                    logp[there] = value[place[there]]
                for a in range(0, len(new), 50_000):
                    some = new[a:a + 50_000]
                    logp[some] = lattice.words(*gather(data, at, some), logs)
                if len(known) + len(new) > KNOWN:
                    known, value = hashes, logp
                elif len(new):
                    known, value = np.append(known, hashes[new]), np.concatenate([value, logp[new]])
                    order = np.argsort(known)
                    known, value = known[order], value[order]
                for k in range(len(langs)):
                    sums[i:j, k] += np.bincount(text, logp[number, k], j - i)
            lettered = np.asarray(batch.column(batch.num_columns - 2).to_pylist(), bool) if langs else np.zeros(batch.num_rows, bool)
            if langs:
                chance = np.exp(sums - sums.max(1, keepdims=True))
                best, chance = sums.argmax(1), (chance / chance.sum(1, keepdims=True)).max(1)
                names = np.where(lettered, np.array(langs, object)[best], "und")
                chance = np.where(lettered, chance, 0.0)
            else:
                names, chance = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            arrays = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(chance)], schema.names)

    return inputs.mapInArrow(run, schema)
