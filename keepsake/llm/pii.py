"""Personal data by pattern, and terms that give it away by information-theoretic sanitisation.

Patterns find protected entities: e-mail addresses, IP addresses, payment cards, phone numbers
(``find``). Every term of a document occurs with each of its entities. Over the corpus, a term's
disclosure of an entity is its pointwise mutual information log2(P(term | entity) / P(term)) by
documents, together with P(entity | term). Both are smoothed: c different contexts weigh
c / (c + PRIOR), the rest is what holds for the kind of entity, or for any document. Contexts are
the words around the term and those around the entity, whichever differ less, so copies add no
evidence. The kind of an entity is judged like an entity whose contexts are the different
entities; that is what is known of entities of one document.

Terms whose information reaches ``BITS`` are generalised if the entity follows from them with
probability ``LIKELY``, and removed from ``CERTAIN`` on, wherever they stand in any document. A
pair of one context is below ``LIKELY``, unless the entity is so frequent that it is below ``BITS``.

Document counts of terms come from all documents. Counts are partial before each shuffle; entity and
term are part of every key, so a frequent entity is spread over its terms.

Defined cases: null or empty texts have no spans; equal spans of two kinds are both kept; a
span that fails its test (parts over 255, checksum, number of digits) is skipped and the
search goes on after it; repeated rows each get their spans. Offsets are code points, end
exclusive. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.session import settle

# Fixed patterns and the order of kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset(chr(b) for b in range(128) if re.match(r"[A-Za-z0-9._%+-]", chr(b)))
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

AROUND = 6
BESIDE = 3
PRIOR = 4.0
BITS = 6.0
LIKELY, CERTAIN = 0.25, 0.5
FOUND = (
    "doc_id long, content long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<kind string, a int, b int>>, entities array<struct<entity string, context long>>, terms array<struct<term string, context long>>"
)


def emails(text: str):
    """Matches around each @, which is the only place where one can be."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in EMAIL_LOCAL:
            begin -= 1
        hit = EMAIL.match(text, begin) if begin < at else None
        if hit:
            done = hit.end()
            yield hit.span()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[tuple[int, int, int]]:
    """Spans of the four kinds as (start, kind number, end), in order."""
    spans = [(a, 0, b) for a, b in emails(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = digits_of(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits_of(m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def digest(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def outside(text: str, spans: list[tuple[int, int, int]]):
    """Matches of the words that touch no span, in order. Spans are in order."""
    k, reach = 0, 0
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            yield m


def contexts(text: str, spans: list[tuple[int, int, int]]) -> tuple[dict[str, int], dict[str, int]]:
    """Entities of the text and its terms outside of them, each with the context of its first place."""
    found = list(outside(text, spans))
    words, starts = [m.group().lower() for m in found], [m.start() for m in found]
    entities: dict[str, int] = {}
    for a, kind, b in spans:
        entity = f"{KINDS[kind]}:{text[a:b].lower() if kind == 0 else digits_of(text[a:b]) if kind > 1 else text[a:b]}"
        if entity not in entities:
            at = bisect(starts, a)
            entities[entity] = digest(words[max(0, at - AROUND):at + AROUND])
    terms: dict[str, int] = {}
    for i, word in enumerate(words):
        if word not in terms:
            terms[word] = digest(words[max(0, i - BESIDE):i + BESIDE + 1])
    return entities, terms


def base(docs: DataFrame) -> DataFrame:
    """Pattern spans of every document, and entities and terms of those that have any."""

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(8)]
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = find(text)
                for k in range(4):
                    columns[k].append(sum(1 for s in spans if s[1] == k))
                named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                columns[4].append(hashlib.sha256(named.encode()).hexdigest())
                columns[5].append([{"kind": KINDS[k], "a": a, "b": b} for a, k, b in spans])
                entities, terms = contexts(text, spans) if spans else ({}, {})
                columns[6].append([{"entity": e, "context": c} for e, c in entities.items()])
                columns[7].append([{"term": t, "context": c} for t, c in terms.items()])
            place = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
            entity = pa.struct([("entity", pa.string()), ("context", pa.int64())])
            term = pa.struct([("term", pa.string()), ("context", pa.int64())])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()),
                pa.array(columns[5], pa.list_(place)), pa.array(columns[6], pa.list_(entity)), pa.array(columns[7], pa.list_(term)),
            ], ["doc_id", "content", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "entities", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(run, FOUND)


def words_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The different words of each document."""
    return docs.select(*columns, F.explode(F.array_distinct(F.split(F.lower("text"), "[^0-9a-z\\x{80}-\\x{10FFFF}]+"))).alias("term"))


def disclosures(docs: DataFrame, found: DataFrame, bits: float = BITS, likely: float = LIKELY, prior: float = PRIOR) -> DataFrame:
    """``entity, term, information, chance`` of every disclosing pair; a kind of entity has no value after its colon."""
    holding = found.filter(F.size("entities") > 0)
    kind = F.concat(F.substring_index("entity", ":", 1), F.lit(":")).alias("kind")
    entities = settle(
        holding.select(F.explode("entities").alias("e")).select("e.entity", "e.context").groupBy("entity", "context").agg(F.count("*").alias("n"))
        .groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count("*").alias("seen")), "entities")
    pairs = settle(
        holding.select(F.explode("entities.entity").alias("entity"), "terms").select("entity", F.explode("terms").alias("t"))
        .groupBy("entity", "t.term", "t.context").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts")), "pairs")
    kinds = F.array_distinct(F.transform("entities.entity", lambda e: F.concat(F.substring_index(e, ":", 1), F.lit(":"))))
    per_kind = holding.select(F.explode(kinds).alias("kind"), "terms.term")
    with_kind = per_kind.groupBy("kind").agg(F.count("*").alias("with_kind"))
    kind_both = per_kind.select("kind", F.explode("term").alias("term")).groupBy("kind", "term").agg(F.count("*").alias("kind_both"))
    # of one context the chance is below what is asked for
    several = pairs.filter("contexts > 1").join(entities.filter("seen > 1"), "entity").select(
        kind, "entity", "term", "both", "with_entity", F.least("contexts", "seen").alias("c"))
    of_kind = pairs.groupBy(kind, "term").agg(F.count("*").alias("c")).filter("c > 1")
    of_kind = of_kind.join(kind_both, ["kind", "term"]).join(with_kind, "kind")
    judged = settle(several.join(kind_both, ["kind", "term"]).join(with_kind, "kind").select(
        "entity", "term", "both", "with_entity", "c", (F.col("kind_both") / F.col("with_kind")).alias("of_kind"),
    ).unionByName(of_kind.select(
        F.col("kind").alias("entity"), "term", F.col("kind_both").alias("both"), F.col("with_kind").alias("with_entity"), "c", F.lit(None).cast("double").alias("of_kind"),
    )), "disclosing-candidates")
    # counted before the join, so that a task sends a row per word and not one per word and document
    counts = words_of(docs).groupBy("term").agg(F.count("*").alias("with_term"))
    total = F.lit(float(docs.count()))
    weight = F.col("c") / (F.col("c") + F.lit(prior))
    in_term = F.col("with_term") / total
    given_entity = weight * F.col("both") / F.col("with_entity") + (1 - weight) * F.coalesce("of_kind", in_term)
    given_term = weight * F.least(F.col("both") / F.col("with_term"), F.lit(1.0)) + (1 - weight) * F.col("with_entity") / total
    return judged.join(counts, "term").select(
        "entity", "term", F.log2(given_entity / in_term).alias("information"), given_term.alias("chance"),
    ).filter((F.col("information") >= bits) & (F.col("chance") >= likely))


def places(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """Document ``d, c`` and the places of its disclosing terms outside pattern spans: ``a, b, remove``."""
    terms = settle(telling.groupBy("term").agg((F.max("chance") >= CERTAIN).alias("remove")), "disclosing-terms")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    # texts of equal id and content are one
    held = settle(words_of(rows, "doc_id", "content").join(terms, "term").groupBy(F.col("doc_id").alias("d"), F.col("content").alias("c")).agg(
        F.collect_set(F.struct("term", "remove")).alias("held")), "documents-with-terms")

    def run(batches):
        for batch in batches:
            out = []
            for text, held in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                remove = {h["term"]: h["remove"] for h in held}
                out.append([{"a": m.start(), "b": m.end(), "remove": remove[w]} for m in outside(text, find(text)) if (w := m.group().lower()) in remove])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("remove", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["d", "c", "terms"])

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))
    marked = rows.join(held, same).select("doc_id", "content", "text", "held").mapInArrow(run, "d long, c long, terms array<struct<a int, b int, remove boolean>>")
    return marked.groupBy("d", "c").agg(F.first("terms").alias("terms"))


def detect(docs: DataFrame) -> DataFrame:
    """Per document its counts, digest of the pattern spans, all spans, and what becomes of disclosing terms."""
    found = settle(base(docs), "pii")
    telling = settle(disclosures(docs, found), "disclosures")
    more = places(docs, telling)
    joined = found.drop("terms", "entities").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left")
    none = F.array().cast("array<struct<a int, b int, remove boolean>>")
    terms = F.coalesce("terms", none)
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat("spans", F.transform(F.array_distinct(F.transform(terms, lambda t: F.struct(t["a"], t["b"]))),
                                          lambda t: F.struct(F.lit("term").alias("kind"), t["a"].alias("a"), t["b"].alias("b"))))
    placed = F.array_sort(F.transform(every, lambda s: F.struct(s["a"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["b"].alias("b"), s["kind"].alias("kind"))))
    return joined.select("doc_id", "content", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", placed.alias("spans"), terms.alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms by their first letter or nothing."""
    found = detect(docs).groupBy("doc_id", "content").agg(F.first("spans").alias("spans"), F.first("terms").alias("terms"))
    keyed = docs.withColumn("_content", F.xxhash64("text"))
    found = found.toDF("_d", "_c", "_spans", "_terms")
    removed = F.transform(F.filter("_terms", lambda t: t["remove"]), lambda t: t["a"])

    def piece(x, s):
        label = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(
            F.when(F.array_contains(removed, s["a"]), F.lit("")).otherwise(F.concat(F.substr("text", s["a"] + 1, F.lit(1)), F.lit("***"))))
        text = F.concat(x["text"], F.substr("text", x["end"] + 1, s["a"] - x["end"]), label)
        return F.when(s["a"] < x["end"], F.struct(x["text"].alias("text"), F.greatest(x["end"], s["b"]).alias("end"))).otherwise(
            F.struct(text.alias("text"), s["b"].alias("end")))

    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    clean = F.aggregate("_spans", begin, piece, lambda x: F.concat(x["text"], F.substr("text", x["end"] + 1)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_content") == F.col("_c"))
    out = keyed.join(found, same, "left").withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(F.col("text")))
    return out.select(*[F.col("_clean").alias(c) if c == "text" else F.col(c) for c in docs.columns])
