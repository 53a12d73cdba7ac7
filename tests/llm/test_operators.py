"""Each operator against a plain version on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import components, decontam, html_extract, jaccard, langid, line_dedup, mixing, pii, ppm, quality, topk
from keepsake.llm import textblocks as tb
from keepsake.llm.common import held_out, prepare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, held_out boolean, note string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    texts = [
        None, "", "   \n ", "a", "Uno dos TRES", PASSAGE, PASSAGE, PASSAGE.upper(), PASSAGE + " thirteen", f"before {PASSAGE}, after",
        "mail Ann.B@example.org or 10.0.0.255 now", "card 4111 1111 1111 1111 and +49 (30) 123-4567 99", "naïve café ÀÉ", "x" * 5000,
        "word " * 20000, "All rights reserved here\nown line of text 1", "All rights reserved here\nown line of text 2",
    ]
    out = []
    for i, text in enumerate(texts * 2):
        lang = [None, "en", "fr"][i % 3]
        out.append((None if i == 20 else i, text, lang, [None, "s1", "s2", ""][i % 4], 1, i % 5 == 0, "n"))
    out.append(out[9])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    prepare(spark)
    return spark.createDataFrame([], DOCS)


def words(text):
    return SOLID.findall((text or "").translate(LOWER))


def test_spans_of_bytes():
    texts = ["Ab cd", "", "é ab", "cd" * 700_000]
    data, offsets = tb.utf8(__import__("pyarrow").array(texts + [None]))
    data = tb.LOWER[data]
    start, end, owner = tb.words(data, offsets, tb.SOLID)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)][:4] == ["ab", "cd", "é", "ab"] and owner.tolist() == [0, 0, 2, 2, 3]
    h = tb.span_hashes(data, start, end)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert [j - i for i, j in tb.chunks(offsets)] == [3, 1, 1]


def ppm_tables(train, order):
    """How often each symbol followed each context of up to ``order`` bytes."""
    tables = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        s = b"\xff" * order + t + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                tables[k][s[i - k:i]][s[i]] += 1
    return tables


def plain_ppm(tables, order, text):
    s, known = b"\xff" * order + text + b"\xff", {}

    def cost(context, symbol):
        total, excluded = 0.0, set()
        for k in range(order, -1, -1):
            met = tables[k].get(context[order - k:], {})
            seen = {a: c for a, c in met.items() if a not in excluded}
            mass = sum(seen.values()) + len(seen)
            if symbol in seen:
                return total + math.log10(seen[symbol] / mass)
            if seen:
                total += math.log10(len(seen) / mass)
            excluded |= set(met)
        return total - math.log10(256 - len(excluded))

    for i in range(order, len(s)):
        key = s[i - order:i + 1]
        if key not in known:
            known[key] = cost(key[:order], key[order])
    return math.fsum(known[s[i - order:i + 1]] for i in range(order, len(s)))


@pytest.mark.parametrize("order, block", [(3, 20_000), (6, 1 << 20)])
def test_op1_whole_table_against_plain_model(spark, docs, none, order, block):
    got = {(r.doc_id, r.n_bytes): r for r in ppm.ppm_scores(docs, order=order, block_bytes=block).collect()}
    every = [(r[0], r[1] or "", r[5]) for r in rows()]
    counts = collections.Counter(w for _, t, h in every if not h for w in [*words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    tables = ppm_tables([t.translate(LOWER).encode() for _, t, h in every if not h], order)
    for doc_id, text, held in every:
        r = got[doc_id, len(text.encode())]
        tokens = [*words(text), "\0end"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, held)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain_ppm(tables, order, text.translate(LOWER).encode()), rel=1e-9)
    assert ppm.ppm_scores(none).count() == 0


def test_op1_is_ppm_with_exclusion():
    order, train, text = 3, [b"abracadabra", b"abrakadabra"], b"abrazca"
    expected = plain_ppm(ppm_tables(train, order), order, text)
    both = train + [text]
    data, offsets = np.frombuffer(b"".join(both), np.uint8), np.cumsum([0] + [len(t) for t in both])
    keys, first = ppm.keys_of(data, offsets, order)
    found, codes = np.unique(keys, return_inverse=True)
    counts = np.bincount(codes[:first[2]], minlength=len(found))
    low = np.zeros((256, 256), np.int64)
    pairs, at = ppm.keys_of(data, offsets, 1)
    np.add.at(low, ((pairs[:at[2]] >> np.uint64(8)).astype(int), (pairs[:at[2]] & np.uint64(255)).astype(int)), 1)
    logs = ppm.log_probabilities(found, counts, low, order)
    assert logs[codes[first[2]:]].sum() == pytest.approx(expected, rel=1e-12)
    context = found[5] >> np.uint64(8)
    every = np.union1d(found, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    counted = np.zeros(len(every), np.int64)
    counted[np.searchsorted(every, found)] = counts
    p = 10 ** ppm.log_probabilities(every, counted, low, order)
    assert p[(every >> np.uint64(8)) == context].sum() == pytest.approx(1)


@pytest.mark.parametrize("doc_id", [None, 3])
def test_op2_rows_of_one_id_are_judged_each(spark, doc_id):
    shared = "a notice on every site"
    lines = [(doc_id, f"own line {i}\n{shared}", "en", f"s{i}", 1, False, "n") for i in range(8)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(lines, DOCS)).collect()
    assert sorted((r.source, r.n_removed) for r in got) == [(f"s{i}", int(i > 0)) for i in range(8)]
    alike = [(doc_id, shared, "en", f"s{i}", 1, False, "n") for i in range(8)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(alike, DOCS)).collect()
    assert sorted((r.source, r.text) for r in got) == [(f"s{i}", "" if i else shared) for i in range(8)]


def test_op2_long_texts_of_boilerplate(spark):
    many = [f"notice {k}" for k in range(30_000)]
    texts = ["\n".join(["own start", *many, "", f"own end {i}"]) for i in range(6)]
    frame = spark.createDataFrame([(i, t, "en", f"s{i}", 1, False, "n") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(frame).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    # "own start" stands on all six sites too
    assert all(got[i].text == f"\nown end {i}" and got[i].n_removed == 30_001 for i in range(1, 6))


def test_op2_boilerplate_lines(spark, docs, none):
    lines = [(i, f"own line number {i}\nshared on many sites here", "en", f"s{i % 6}" if i else None, 1, False, "n") for i in range(12)]
    lines += [(100, None, "en", None, 1, False, "n"), (101, "", "en", "s1", 1, False, "n"), (12, "shared on many sites here\n  shared on many sites here ", "en", "s9", 1, False, "n")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(lines, DOCS)).collect()}
    assert got[0].text.count("\n") == 1 and got[0].n_removed == 0
    assert got[5].text == "own line number 5" and (got[5].n_lines, got[5].n_removed) == (2, 1)
    assert got[12].text == "" and got[100].text is None and (got[100].n_lines, got[101].n_lines) == (0, 1)
    assert got[3].note == "n"
    few = line_dedup.drop_boilerplate(spark.createDataFrame(lines, DOCS), min_sites=9)
    assert few.agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.drop_boilerplate(docs).count() == len(rows()) and line_dedup.drop_boilerplate(none).count() == 0


def test_line_dedup_judges_short_lines(spark):
    lines = [(i, f"Les.\n\n版权所有不得转载\nAnd ornd.\n\t\nown line {i}", "fr", f"s{i}", 1, False, "n") for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(lines, DOCS)).collect()}
    assert got[0].n_removed == 0 and all(got[i].text == f"\n\t\nown line {i}" and got[i].n_removed == 3 for i in range(1, 6))


def test_op3_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(20)] + [(400, None), (401, [float("nan")] * 16), (402, [None] * 16), (450, [1.0, 2.0]), (500, [3.0, -1.0])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, rows=100, queries=3).collect()]
    usable = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in [i for i in usable if i % 50 == 0]:
        found = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    assert sorted(got) == sorted(expected)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("item_bytes", [4 << 20, 60])
def test_op4_windows(spark, docs, none, item_bytes):
    items = [(1, PASSAGE), (2, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (3, "uno dos"), (4, None), (5, "..."), (10, PASSAGE.title())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.content): r for r in decontam.contamination(docs, bench, item_bytes=item_bytes).collect()}
    for key, r in got.items():
        text = next(t for i, t, *_ in rows() if i == key[0] and True)
        own, hit, found = alnum(text), set(), set()
        for i, item in items:
            w = alnum(item)
            for win in ([w[k:k + 10] for k in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []):
                for p in range(len(own) - len(win) + 1):
                    if own[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(i))
        assert (r.n_words, r.n_hit, r["items"]) == (len(own), len(hit), sorted(found))
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_op5_targets_and_positions(spark, docs, none):
    got = mixing.by_first_use(mixing.mix(docs)).collect()
    assert len(got) == len(rows())
    total, by_source = 0, collections.defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
        total += r.size
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
    for part in by_source.values():
        assert sum(r.taken for r in part) == math.floor(part[0].target) and part[0].target <= 2 * part[0].source_size
    assert sum(p[0].target for p in by_source.values()) == pytest.approx(1.5 * total)
    used = [r.position for r in got if r.position is not None]
    assert used == sorted(used)
    order = mixing.training_order(mixing.mix(docs)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and sum(r.words for r in order) == sum(r.taken for r in got)
    assert mixing.mix(none).count() == 0


def test_op6_learns_and_is_calibrated(spark, none):
    made = []
    for i in range(600):
        bad = i % 4 == 0
        made.append((i, " ".join((f"w{(i * 7 + k * 3) % 50}" + ("%%%" if bad else "")) for k in range(30)), int(not bad)))
    frame = spark.createDataFrame(made, "doc_id long, text string, quality int")
    extra = spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")
    learn = ~held_out("doc_id", 4, 2)
    scored = quality.score(frame.select("doc_id", "text").union(extra), frame.select("doc_id", "quality"), learn, ["doc_id"]).collect()
    truth = {i: q for i, _, q in made}
    assert len(scored) == 602 and all(0 <= r.score <= 1 for r in scored)
    apart = [r for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in apart]) > 0.95
    assert quality.score(none, frame.select("doc_id", "quality"), learn, ["doc_id"]).count() == 0
    again = frame.select("doc_id", "text").union(frame.selectExpr("doc_id", "concat(text, ' more')"))
    a, b = (sorted(r.score for r in quality.score(x, frame.select("doc_id", "quality"), learn, ["doc_id"], sample=40).collect())
            for x in (again, again.orderBy(F.desc("text"))))
    assert a == pytest.approx(b, rel=1e-9)
    named = quality.keep_good(frame.selectExpr("*", "1 as score"), frame.select("doc_id", "quality"), learn, 0.0)
    assert named.columns == [*frame.columns, "score"] and named.filter("score = 1").count() == len(made)
    only = quality.score(frame.select("doc_id", "text"), frame.filter("quality = 5").select("doc_id", "quality"), learn, ["doc_id"])
    assert {r.score for r in only.collect()} == {0.5}


def test_op6_memory_follows_a_chunk_not_a_batch(monkeypatch):
    """4 MB of texts in one batch: the arrays of a task stay below 32 MB, and the chunk changes no bit of the results."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    known = [f"{'aZé7'[k % 4]}{k:x}" for k in range(5000)]
    texts = pa.array([None, "", *(" ".join(known[k] for k in rng.integers(0, 5000, 800)) for _ in range(1000)), "long " * 20000])
    place, sign = quality.index_vectors()
    vectors = rng.normal(size=(quality.WORDS, quality.SIZE)).astype(np.float32)
    found = []
    for chunk in (quality.CHUNK, 1 << 20):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        total, peaks = np.zeros(quality.WORDS * quality.SIZE, np.int64), []
        tracemalloc.start()
        quality.add_neighbours(total, texts, place, sign)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.reset_peak()
        x = quality.pooled(texts, vectors)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found.append((peaks, total, x))
    assert texts.nbytes > 4e6 and max(found[0][0]) < 32e6, found[0][0]
    assert (found[0][1] == found[1][1]).all() and (found[0][2] == found[1][2]).all() and found[0][2].shape == (1003, quality.FEATURES)


def test_op7_spans_and_disclosing_terms(spark, docs, none):
    cases = ["a@b", "x a@b.c.d.", "@a.b c@d@e.f", "1.2.3.4.5 999.1.1.1 1.1.1.1", "4111-1111 1111 1111 9", "4111111111111111", "++49 30 1234567 +1", "é j.d@x-y.org +49(30)1234567.9"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in cases + ["".join("a@.b1+ 4"[k % 8] for k in range(n * n)) for n in range(2, 12)]:
        assert [s for s in pii.emails(text)] == [m.span() for m in email.finditer(text)]
    assert pii.find(cases[5]) == [(0, 2, 16)] and pii.find(cases[3]) == [(0, 1, 7), (20, 1, 27)]
    got = [r for r in pii.detect(docs).collect()]
    assert len(got) == len(rows()) and sum(r.n_email for r in got) == 2 and sum(r.n_card for r in got) == 2
    told = [(i, f"plain text {i} of number {i * 3} zorblax writes to z.b@mail.org about matter {i * 5} today") for i in range(8)]
    told += [(100 + i, f"plain text of number {i} about matter today writes to nobody") for i in range(1000)]
    frame = spark.createDataFrame(told, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detect(frame).collect()}
    terms = {told[3][1][s.a:s.b] for s in found[3].spans if s.kind == "term"}
    assert "zorblax" in terms and "to" not in terms and not found[105].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "zorblax" not in clean[3] and "[EMAIL]" in clean[3] and clean[105] == told[13][1]
    assert pii.detect(none).count() == 0


def test_op7_terms_anywhere_and_rare_entities(spark):
    far = " ".join(f"filler{k}" for k in range(40))
    # the term stands far from the entity, twice, and in a document without it
    told = [(i, f"note {i} about quibblor and {i * 7} {far} answer {i * 11} goes to far.off@mail.org") for i in range(6)]
    told += [(20, "here quibblor stands alone")]
    # each address once, one term for all of them; two contexts of one address
    told += [(30 + i, f"case {i} the glimmertod {i * 13} of {far} {i * 17} reaches +49 30 12345{i:02d} now") for i in range(6)]
    told += [(40 + i, f"file {i} on snorvex {i * 19} {far} {i * 23} from 10.1.2.3 sent") for i in range(2)]
    # copies give no evidence
    told += [(50 + i, f"{far} wuzzle of {far} at 10.9.9.9 end{' of copy' * (i % 2)}") for i in range(6)]
    told += [(100 + i, f"note about case the file on of {far} answer goes to reaches now from sent end copy {i}") for i in range(2000)]
    frame = spark.createDataFrame(told, "doc_id long, text string")
    text = dict(told)
    marked = {r.doc_id: {text[r.doc_id][s.a:s.b] for s in r.spans if s.kind == "term"} for r in pii.detect(frame).collect()}
    assert all("quibblor" in marked[i] for i in (*range(6), 20)) and all("glimmertod" in marked[30 + i] for i in range(6))
    assert "snorvex" in marked[40] and "snorvex" in marked[41]
    assert not any("wuzzle" in m or "filler3" in m for m in marked.values()) and not marked[105]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "quibblor" not in clean[20] and "s***" in clean[40] and "wuzzle" in clean[50]


def test_op8_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    lattice = langid.Lattice(pieces)
    p = np.array([0.3, 0.2, 0.2, 0.2, 0.1])

    def total(word):
        return 1.0 if not word else sum(p[i] * total(word[len(x):]) for i, x in enumerate(pieces) if word.startswith(x))

    listed = [b"abab", b"b", b"ababa"]
    data, at = np.frombuffer(b"".join(listed), np.uint8), np.cumsum([0] + [len(w) for w in listed])
    assert np.exp(lattice.words(data, at, np.log(p)[:, None])[:, 0]) == pytest.approx([total(w) for w in listed])
    uses = lattice.uses(data, at, np.ones((3, 1)))[:, 0]
    assert (uses * [len(x) for x in pieces]).sum() == pytest.approx(sum(map(len, listed)))


def test_op8_languages(spark, docs, none):
    texts = {"en": "the house and the garden with this thing", "fr": "la maison et le jardin avec cette chose où été"}
    made = [(i, texts[k], k) for i, k in enumerate(["en", "fr"] * 10)] + [(50, None, "en"), (51, "123 .", "fr"), (52, "garden house " + "z" * 500, None)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame, frame, ["doc_id"]).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "fr" and got[52].lang_pred == "en"
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[51].score == 0
    assert all(r.lang_pred == "und" for r in langid.identify(docs, none, ["doc_id"]).collect())
    assert langid.identify(none, docs, ["doc_id"]).count() == 0


def test_op9_article(spark):
    def page(n, inner):
        return (f"<html><head><title>T</title><style>p{{}}</style></head><body><div>Site name</div><nav><a href=x>Menu {n}</a></nav>{inner}"
                f"<div>Subscribe to us</div><div class='comment'>nice {n}</div><footer>&copy; {n}</footer></body></html>")

    pages = [(i, "http://h.example/%d" % i, page(i, f"<article><header><h1>Head {i}</h1></header><p>A &amp;  b\n{i}<p>Second<br>part</article>")) for i in range(4)]
    pages += [(10 + i, "http://k.example/%d" % i, page(i, f"<div><p>Story number {i} is told here.</p><script>x='<p>'</script><form>f</form></div>")) for i in range(4)]
    pages += [(20, None, None), (21, "bad url", ""), (22, "http://z.example", "<div>" * 1000 + "deep"), (23, "http://z.example", "plain &lt;text")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head 1\nA & b 1\nSecond part"
    assert got[12] == "Story number 2 is told here."
    assert got[20] == got[21] == "" and got[22] == "deep" and got[23] == "plain <text"


def test_op9_host_template_decides(spark):
    story = "Story number {0} of this site tells at length about matter {0} and what became of it."
    notice = "<p>Read our newsletter every day.</p>"
    teaser = "<article><p>Teaser {0}</p></article>"
    pages = [(i, "http://in.example/%d" % i, f"<body><article><h1>Head {i}</h1><p>{story.format(i)}</p>{notice}</article><div class=ad>buy {i}</div></body>") for i in range(8)]
    # content outside the marked articles
    pages += [(20 + i, "http://out.example/%d" % i, f"<body>{teaser.format(i)}<div class=text><p>{story.format(i)}</p></div></body>") for i in range(8)]
    # on most pages, not on those of the smallest hashes alone; a sentence two pages share stays
    pages += [(40 + i, "http://part.example/%d" % i, f"<body>{'<div>Closed on Monday</div>' if i % 4 else ''}<div><p>{story.format(i)}</p>{'<p>Told by two.</p>' if i < 2 else ''}</div></body>") for i in range(16)]
    # two pages, and long flat pages
    pages += [(60 + i, "http://two.example/%d" % i, f"<body><div>Menu of two</div><p>{story.format(i)}</p></body>") for i in range(2)]
    flat = [f"<p>line {{0}} {k}</p><p>Fixed {k}</p>" for k in range(500)]
    pages += [(70 + i, "http://wide.example/%d" % i, "<body>" + f"<i>{i}</i><p>{i}</p>" * i + "".join(flat).format(i) + f"<p>{i}</p>" * i + "</body>") for i in range(6)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert all(got[i] == f"Head {i}\n{story.format(i)}" for i in range(8))
    assert all(got[20 + i] == story.format(i) for i in range(8))
    assert all(got[40 + i] == story.format(i) + "\nTold by two." * (i < 2) for i in range(16))
    assert all(got[60 + i] == story.format(i) for i in range(2))
    assert all("Fixed" not in got[70 + i] and got[70 + i].count(f"line {i} ") == 500 for i in range(6))


def plain_components(made, width=5):
    sets = []
    for _, text, *_ in made:
        w = words(text)
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    ids = [r[0] for r in made]
    parent = {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            if sets[i] and sets[j] and ids[i] is not None and ids[j] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return collections.Counter((i, len(s), root(i)) for i, s in zip(ids, sets) if i is not None)


def test_op10_components(spark, docs, none):
    rng = np.random.default_rng(5)
    base = [f"t{k}" for k in range(120)]
    made = []
    for i in range(90):
        w = list(base) if i < 60 else [f"u{i}-{k}" for k in range(60)] + base[:60]
        for k in rng.integers(0, len(w), rng.integers(0, 5)):
            w[k] = f"e{i}-{k}"
        made.append((int(i), " ".join(w)))
    made += [(r[0], r[1]) for r in [(200 + k, t) for k, t in enumerate([None, "", "a b", "A  b", "a b c d e", "A b\nc d e"])]]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(frame).collect())
    assert got == plain_components(made)
    own = [(r[0], r[1]) for r in rows()]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect() if r.doc_id is not None)
    assert got == plain_components(own)
    assert jaccard.link(none).count() == 0
    kept = sorted(r.doc_id for r in jaccard.keep_one(frame).collect())
    assert kept == sorted(i for i, _, c in plain_components(made) if i == c)


@pytest.mark.parametrize("block", [2, 2048])
def test_op10_pairs_across_components(spark, monkeypatch, block):
    """Long lists that meet block by block give each pair as often as it shares shingles."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(11)
    sets = {k: set(rng.choice(40, 24, replace=False).tolist()) for k in range(24)} | {30 + k: set(range(23 + k)) for k in range(9)}
    component = {k: k // 2 for k in sets}
    bits = []
    for k, s in sets.items():
        marks = np.zeros(64 * jaccard.SKETCH, bool)
        marks[list(s)] = True
        bits.append((k, np.packbits(marks).view(np.int64).tolist()))
    lists = [(t, k, len(s), 1, component[k]) for k, s in sets.items() for t in s]
    kind = "token long, cls long, n long, ask int, component long"
    marked = spark.createDataFrame(lists, kind)
    marks = spark.createDataFrame(bits, "cls long, bits array<long>")
    got = sorted((r.a, r.b) for r in jaccard.across_components(jaccard.in_parts(marked, 16).join(marks, "cls"), 75).collect())
    assert got == sorted(
        (a, b) for a, x in sets.items() for b, y in sets.items()
        if a < b and component[a] != component[b] and 100 * len(x & y) >= 75 * len(x | y))
    assert got
    dealt = jaccard.in_parts(spark.createDataFrame([], kind), 16).join(marks, "cls")
    assert jaccard.across_components(dealt, 75).count() == 0


def near_copies():
    """Three groups of near copies, chains of texts that each differ a little from the one before, and texts of their own."""
    rng = np.random.default_rng(23)
    made = []
    for g in range(3):
        for _ in range(25):
            w = [f"g{g}-{k}" for k in range(100)]
            for k in rng.integers(0, 100, rng.integers(0, 4)):
                w[k] = f"e{len(made)}"
            made.append(w)
    for c in range(2):
        made += [[f"c{c}-{k}" for k in range(6 * i, 6 * i + 100)] for i in range(20)]
    made += [[f"s{i}-{k}" for k in range(40)] for i in range(20)]
    return [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(made)), made)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_op10_rounds_decide_cost_only(spark, monkeypatch, rounds):
    prepare(spark)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    made = near_copies()
    frame = spark.createDataFrame(made, "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(frame).collect()) == plain_components(made)


def test_op10_steps(spark, monkeypatch):
    """Rounds ask for no exact components, which are found once."""
    prepare(spark)
    steps = collections.Counter()
    for module in (jaccard, components):
        monkeypatch.setattr(module, "settle", lambda df, purpose, f=module.settle: (steps.update([purpose]), f(df, purpose))[1])
    jaccard.link(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    assert steps["star"] >= 1 and steps["edges"] <= 6 and sum(steps.values()) <= 25, steps


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_op10_moves_texts_of_candidates_only(spark, monkeypatch, bits):
    """Texts are not written, only those of candidates' documents go on, and no pair is checked again once it has failed."""
    prepare(spark)
    monkeypatch.setattr(jaccard, "MARKS", bits)
    written, moved = [], []
    monkeypatch.setattr(jaccard, "settle", lambda df, purpose, f=jaccard.settle: (written.append((purpose, out := f(df, purpose))), out)[1])
    monkeypatch.setattr(jaccard, "marked", lambda docs, ends, f=jaccard.marked: (moved.append((ends, out := f(docs, ends))), out)[1])
    made = near_copies()
    linked = jaccard.link(spark.createDataFrame(made, "doc_id long, text string"))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in linked.collect()) == plain_components(made)
    assert not [purpose for purpose, df in written if "text" in df.columns]
    failed = set()
    for purpose, df in written:
        if purpose in ("star", "pairs"):
            assert not failed & {(r.a, r.b) for r in df.collect()}
        elif purpose == "links":
            failed |= {(r.a, r.b) for r in df.filter("not similar").collect()}
    assert failed and len(moved) >= 2
    for ends, docs in moved:
        asked, got = ({r.doc_id for r in x.select("doc_id").collect()} for x in (ends, docs))
        assert asked <= got and (bits == 64 or asked == got)


def test_op10_spread_labels(spark):
    labels = spark.createDataFrame([(k, 9, k // 2 * 2) for k in range(12)], "cls long, n long, component long")
    found = spark.createDataFrame([(4, 6), (2, 6), (6, 8)], "la long, lb long")
    got = {r.cls: r.component for r in jaccard.spread(labels, found).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2, 9: 2, 10: 10, 11: 10}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(components, "settle", lambda df, purpose, f=components.settle: (steps.append(purpose), f(df, purpose))[1])
    edges = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(1, 4), (None, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: i % 3 for i in range(30)}
    assert steps == ["edges"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
