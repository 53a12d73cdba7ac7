"""Resampling, manifest and packing against plain versions, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check
from conftest import SF
from keepsake.llm import importance, merkle, packing, queries
from keepsake.llm.common import prepare, remainder
from test_operators import DOCS, LOWER, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# extra columns under names that the operators use themselves
CLASHING = ["n", "pos", "hash", "t", "s", "node", "block", "path", "score", "rank", "length", "piece", "ids", "_at", "_part", "_tie", "_u", "_bucket", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    found = spark.createDataFrame(rows(), DOCS)
    return found.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark):
    prepare(spark)
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_importance_sample", "op12_merkle_manifest"])
def test_same_rows_as_sql(spark, name):
    con = check.oracle_connection(SF)
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    want = check.comparable([d[0] for d in cur.description], cur.fetchall())
    assert check.comparable(got.columns, [tuple(r) for r in got.collect()]) == want


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def test_op11_against_plain(spark, docs, none):
    target = spark.createDataFrame([("uno dos tres",), (None,), ("word word",)], "text string")
    s, t = collections.Counter(), collections.Counter()
    for r in rows():
        s.update(zlib.crc32(f.encode()) % 10000 for f in features(r[1])[1])
    for text in ("uno dos tres", "word word"):
        t.update(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])
    total, aim = sum(s.values()), sum(t.values())
    expected, scored = [], []
    for r in rows():
        words, found = features(r[1])
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in (zlib.crc32(f.encode()) % 10000 for f in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha(f"7:{'' if r[0] is None else r[0]}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        expected.append((-1 if r[0] is None else r[0], len(found), weight, score))
        if len(words) >= 4:
            scored.append((-score, -1 if r[0] is None else r[0], len(found)))
    got = importance.resample(docs, target, least=4, percent=40).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "n_features", "weight", "score", "rank").collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(expected)
    drawn = sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None)
    chosen = sorted(scored)[:40 * len(scored) // 100]
    assert [(i + 1, d, -s) for i, (s, d, _) in enumerate(chosen)] == drawn and len(drawn) > 3
    assert importance.resample(none, target).count() == 0
    assert importance.resample(docs, target.limit(0)).filter("rank is not null").count() == 25 * sum(len(features(r[1])[0]) >= 20 for r in rows()) // 100
    assert importance.resample(docs, target, least=10 ** 9).filter("rank is not null").count() == 0


def test_crc_composition():
    shifts = importance.Shifts()
    texts = ["a bb ccc", "é naïve " + "x" * 3000, "", "one", "日本語 テキスト 1"]
    column = pa.array([*texts, None, "A-B\x7fC"])
    (i, j, found), = importance.chunks_of(column)
    assert (i, j) == (0, 7) and found[-1] == b"a b c"
    for k, (got, owner) in enumerate(importance.buckets_of(found, 3, 1 << 31, shifts)):
        want = []
        for n, text in enumerate(found):
            w = text.split()
            want += [(zlib.crc32(b" ".join(w[m:m + k + 1])) % (1 << 31), n) for m in range(len(w) - k)]
        assert list(zip(got.tolist(), owner.tolist())) == want


def plain_tree(level, fanout=16):
    """Root, and for each leaf the nodes before and after it level by level."""
    paths, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(place):
            a = p // fanout * fanout
            paths[i].append(("".join(level[a:p]), "".join(level[p + 1:a + fanout])))
            place[i] = p // fanout
        level = [sha("".join(level[a:a + fanout])) for a in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(table, fanout):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = collections.defaultdict(list)
    for r in table:
        present = leaf(r, r[1].translate(LOWER) if r[1] is not None else None) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None
        groups["" if r[3] is None else "=" + r[3]].append((-1 if r[0] is None else r[0], leaf(r, r[1]), present))
    names = sorted(groups, key=str.encode)
    trees = {g: plain_tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        for (doc, first, present), path in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1]):
            node = present or first
            for a, b in path + top:
                node = sha(a + node + b)
            out.append((doc, first, trees[g][0], root, sha("".join(x for s in path + top for x in s)), node))
    return sorted(out)


@pytest.mark.parametrize("fanout,levels", [(16, 3), (2, 1), (3, 2), (4, 1)])
def test_op12_against_plain(spark, docs, none, fanout, levels):
    """Small fanouts make many rounds, with last nodes that cover few blocks."""
    table = rows()
    got = merkle.manifest(docs, remainder("doc_id", 5) == 0, fanout, levels)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == plain_manifest(table, fanout)
    if fanout == 16:
        assert merkle.manifest(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("many,fanout,levels", [(1, 2, 1), (23, 2, 1), (83, 3, 1), (130, 4, 1), (257, 16, 1)])
def test_op12_one_source(spark, many, fanout, levels):
    table = [(i, f"Text {i}", "en", "hot", i) for i in range(many)]
    got = merkle.manifest(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long"), remainder("doc_id", 5) == 0, fanout, levels)
    assert sorted(tuple(r) for r in got.collect()) == plain_manifest(table, fanout)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{queries.TOKENIZERS}/{queries.VOCABULARY}")


def test_op13_ids_are_the_tokenizers(spark, docs):
    texts = [r[1] for r in rows()] + ["It's NAÏVE — 日本語テキスト é ́x 12345 don't\tTABS\x0b\x0c\x85 ΣΑΣ İ ﬁ", "<|endoftext|> end", "a" * 9000, "\n\n",
        "É1Èé×÷İstanbul Āſ ɏɐ Ⱥé. ÀB-c\u0301 naïve,œuvre' x\u0130y ª µº Ǆ ÿ\u00d7", *["".join(map(chr, range(k, k + 64))) for k in range(0x80, 0x400, 64)]]
    full = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    t = tokenizer()
    for by_word in (True, False):
        got = collections.defaultdict(dict)
        for r in packing.pieces(full, f"{queries.TOKENIZERS}/{queries.VOCABULARY}", 64, by_word=by_word).collect():
            assert r.start == r.piece * 64 and r.length * 4 == len(r.ids)
            got[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
        for i, text in enumerate(texts):
            ids = [x for k in range(len(got[i])) for x in got[i][k]]
            assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 0]
            assert all(len(got[i][k]) == 64 for k in range(len(got[i]) - 1))


def test_op13_units_are_looked_up_once_and_tokenised_in_batches(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_UNITS", 12)
    texts = ["Älter Straße naïve-Ōsaka don't 42 ¡hola! ÿÉ", "", "Straße again, AGAIN Ǆ x" + "y" * 300, "日本 “q” a\u0301b Straße 42"] * 2 + ["one two three four", "five six seven eight nine ten eleven"]
    t = tokenizer()
    for many in (1, 3, len(texts)):
        known, learnt, lookups = packing.Units(t.to_str()), [], []
        monkeypatch.setattr(known, "learn", lambda new, f=known.learn: (learnt.extend(new), f(new)))
        monkeypatch.setattr(known, "places", lambda units, f=known.places: (lookups.append(units), f(units))[1])
        for k in range(0, len(texts), many):
            some = [x.encode() for x in texts[k:k + many]]
            data, at = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
            ids, ends = packing.tokens_by_word(known, data, at, 0)
            want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts[k:k + many]]
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        # a chunk asks once for its different units, and the memory was emptied on the way
        assert len(lookups) == -(-len(texts) // many) and all(len(set(u)) == len(u) for u in lookups)
        assert len(known.place) == len(known.start) <= max(12, max(map(len, lookups))) and (many > 3 or len(learnt) > len(known.place))


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_op13_packs(spark, docs, none):
    cut = packing.pieces(docs, f"{queries.TOKENIZERS}/{queries.VOCABULARY}", 256)
    packed = packing.placed(cut.withColumn("note", F.lit(1)), 256)
    got = packed.collect()
    assert len(got) == cut.count() and packed.columns[-3:] == ["note", "sequence_id", "offset"]
    inside = collections.defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(inside) <= plain_best_fit([r.length for r in got], 256)
    joined = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in got:
        assert bytes(joined[r.sequence_id].ids)[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.placed(packing.pieces(none, f"{queries.TOKENIZERS}/{queries.VOCABULARY}")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_op13_plan_is_best_fit(seed):
    random = np.random.default_rng(seed)
    capacity = int(random.integers(5, 120))
    lengths = random.integers(1, capacity + 1, int(random.integers(1, 600)))
    if seed % 2:
        lengths = np.maximum(1, lengths // 3)
    plan = packing.planned(np.bincount(lengths, minlength=capacity + 1), capacity)
    held, ranks = collections.defaultdict(list), collections.Counter()
    for length, first, pieces, sequence, each, used in plan.steps:
        assert first == ranks[length]
        ranks[length] += pieces
        for r in range(pieces):
            held[sequence + r // each].append((used + r % each * length, length))
    assert ranks == collections.Counter(lengths.tolist()) and sorted(held) == list(range(plan.sequences))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and sum(n > capacity // 3 for _, n in parts) <= 2
    assert plan.sequences <= plain_best_fit(lengths.tolist(), capacity) + 1
