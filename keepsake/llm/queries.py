"""The registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import decontam, html_extract, importance, jaccard, langid, line_dedup, merkle, mixing, packing, pii, ppm, quality, topk
from keepsake.llm.common import held_out, prepare, read, remainder

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "word_bpe_49k.json"

# CRC-32 in SQL: a table of 256 registers by rule, then one step a byte.
CRC_TABLE = """select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from range(256) r(i)"""
CRC = """xor(list_reduce(list_transform(range(len(hex(encode({0}))) // 2), lambda i: ('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2])::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"""
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(lambda table: read(spark, folder, table))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_lm_score")
def op1(table):
    return ppm.ppm_scores(table("documents").withColumn("held_out", held_out("doc_id", 10, 0)))


@query("op2_line_dedup", r"""
with lines as (
  select doc_id, coalesce('=' || source, '') site, i - 1 as pos, trim(parts[i], ' ') as line
  from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) i
        from (select doc_id, source, string_split(text, chr(10)) parts from documents))
), judged as (select * from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
), bad as (
  select line, min((doc_id, pos)) f from judged group by line having count(distinct site) >= 5
), gone as (select j.doc_id, j.pos from judged j join bad b on j.line = b.line and (j.doc_id, j.pos) <> b.f
), cut as (select doc_id, list(pos) l from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::int as n_lines, coalesce(len(c.l), 0)::int as n_removed,
  case when c.l is null then d.text else array_to_string([x for x, i in string_split(d.text, chr(10)) if not list_contains(c.l, i - 1)], chr(10)) end as text
from documents d left join cut c using (doc_id)
""")
def op2(table):
    return line_dedup.drop_boilerplate(table("documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op3_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (select q.vec_id as query_id, r.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i]))::bigint as score
  from v q join v r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id and len(q.e) = len(r.e))
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs) where rank <= 5
""")
def op3(table):
    return topk.search(table("embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_decontaminate")
def op4(table):
    found = decontam.contamination(table("documents"), table("benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_mix_sources", r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as kind from d group by source
), w as (select *, case kind when 0 then 3 when 1 then 1 else 2 end as weight, 2 * source_size as room from s
), r as (select *, room / weight as ratio, row_number() over (order by room / weight, source nulls last) as o from w
), l as (select *, ((select sum(source_size) from s) * 1.5::double - coalesce(sum(room) over (order by o rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by o rows between unbounded preceding and 1 preceding), 0)) as level from r
), t as (select source, source_size, kind, least(room::double, (select arg_min(level, o) from l where level <= ratio) * weight) as target from l
), p as (select d.doc_id, d.size, t.source_size, t.kind, t.target,
    sum(d.size) over (partition by d.source order by md5(d.doc_id::varchar), d.doc_id, d.size rows unbounded preceding) - d.size as start
  from d join t on d.source is not distinct from t.source
), u as (select *, greatest(least(floor(target) - start, size), 0)::bigint as one, greatest(least(floor(target) - start - source_size, size), 0)::bigint as two from p
), q as (select *, case when one > 0 then start / target when two > 0 then (start + source_size) / target end as q from u
), k as (select *, case when q < (case kind when 0 then 0.5 when 1 then 0.625 else 0.375 end) then 0 else 1 end as i,
    case kind when 0 then 0.0 when 1 then -0.5 else 0.5 end::double as d from q
), m as (select *, (case kind when 0 then 1.0 when 1 then 1.5 else 0.5 end)::double + i * d as a,
    (q - case when i = 0 then 0 else case kind when 0 then 0.5 when 1 then 0.625 else 0.375 end end) * 2 as rest from k)
select doc_id, size, source_size, target, (one + two)::bigint as taken,
  case when q is not null then round(least((i + 2 * rest / (a + sqrt(greatest(a * a + 2 * d * rest, 0)))) / 2, 1), 9) end as position from m
""")
def op5(table):
    return mixing.by_first_use(mixing.mix(table("documents"))).select("doc_id", "size", "source_size", "target", "taken", "position")


@query("op10_jaccard_join")
def op10(table):
    return jaccard.link(table("documents"))


@query("op6_quality")
def op6(table):
    docs = table("documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2))
    scored = quality.score(docs, table("labels"), ~held_out("doc_id", 4, 2), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op8_language_id")
def op8(table):
    docs = table("documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    return langid.identify(docs, docs.filter("not held_out"), ["doc_id", "held_out"])


@query("op7_pii")
def op7(table):
    places = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"]))
    return pii.detect(table("documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(places, ",").alias("spans"))


@query("op9_main_text")
def op9(table):
    return html_extract.extract(table("pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def importance_sql() -> str:
    lower = ASCII_LOWER.format("text")
    words = rf"coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    runs = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with crc as ({CRC_TABLE}
), d as (select doc_id, {words} w from documents
), df as (select doc_id, unnest({runs}) f from d
), bf as (select unnest({runs}) f from (select {words} w from benchmark)
), hashed as (select f, {CRC.format("f")} % 10000 as b from (select distinct f from (select f from df union all select f from bf)), crc
), s as (select b, count(*) n from df join hashed using (f) group by b
), t as (select b, count(*) n from bf join hashed using (f) group by b
), gain as (select r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from df) + 10000)
      / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bf) + 10000))))::bigint g
    from range(10000) r(b) left join s using (b) left join t using (b)
), total as (select doc_id, count(*) n, sum(g) g from df join hashed using (f) join gain using (b) group by doc_id
), scored as (select d.doc_id, len(w) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(floor(g / n), 0)::bigint as weight,
      ('0x' || sha256('7:' || d.doc_id)[1:8])::bigint h from d left join total using (doc_id)
), final as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored
), ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () n from final where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 25 * n // 100 then r end as rank from final left join ranked using (doc_id)
"""


@query("op11_importance_sample", importance_sql())
def op11(table):
    return importance.resample(table("documents"), table("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def tree_sql(name: str, leaves: str, depth: int) -> str:
    """CTEs of the levels of all trees of ``leaves`` (t, pos, n, h), nodes with what stands before and after them in their run."""
    parts = [f"{name}0 as (select t, pos as p, n, h from {leaves})"]
    for k in range(depth):
        parts.append(f"""{name}_side{k} as (select x.t, x.p, coalesce(string_agg(y.h, '' order by y.p) filter (y.p < x.p), '') before,
      coalesce(string_agg(y.h, '' order by y.p) filter (y.p > x.p), '') after
    from {name}{k} x join {name}{k} y on x.t = y.t and x.p // 16 = y.p // 16 where x.n > {16 ** k} group by x.t, x.p)""")
        parts.append(f"""{name}{k + 1} as (select t, p // 16 as p, n, case when n > {16 ** k} then sha256(string_agg(h, '' order by p)) else min(h) end h
    from {name}{k} group by t, p // 16, n)""")
    return ",\n  ".join(parts)


def folded_sql(node: str, name: str, depth: int) -> str:
    for k in range(depth):
        node = f"case when {name}{k}.before is null then {node} else sha256({name}{k}.before || {node} || {name}{k}.after) end"
    return node


def sides_sql(name: str, tree: str, position: str, depth: int) -> str:
    return "\n  ".join(f"left join {name}_side{k} {name}{k} on {name}{k}.t = {tree} and {name}{k}.p = {position} // {16 ** k}" for k in range(depth))


def merkle_sql(depth: int = 6, wide: int = 5) -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"

    def proof(name: str, n: int) -> str:
        return " || ".join(f"coalesce({name}{k}.before || {name}{k}.after, '')" for k in range(n))

    return f"""
with crc as ({CRC_TABLE}
), docs as (select doc_id, coalesce('=' || source, '') t, {leaf("text")} h,
    case when {CRC.format("doc_id::varchar")} % 5 = 0 then {leaf(ASCII_LOWER.format("text"))} end present from documents, crc
), leaves as (select *, row_number() over (partition by t order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by t) as n from docs
), {tree_sql("a", "leaves", depth)}
, subroots as (select t as s, '' as t, h, row_number() over (order by t) - 1 as pos, count(*) over () as n from a{depth}
), {tree_sql("b", "subroots", wide)}
, inner_fold as (select l.doc_id, l.h as leaf, l.t, {proof("a", depth)} as proof, {folded_sql("coalesce(l.present, l.h)", "a", depth)} as node
  from leaves l {sides_sql("a", "l.t", "l.pos", depth)}
), outer_part as (select s.s, s.h as subroot, (select h from b{wide}) as root, {proof("b", wide)} as proof,
    [{", ".join(f"b{k}.before" for k in range(wide))}] as before, [{", ".join(f"b{k}.after" for k in range(wide))}] as after
  from subroots s {sides_sql("b", "''", "s.pos", wide)}
), done as (select doc_id, leaf, subroot, root, sha256(i.proof || o.proof) as proof_sha256,
    list_reduce(range(1, {wide + 1}), lambda x, k: case when before[k] is null then x else sha256(before[k] || x || after[k]) end, node) as folded_root
  from inner_fold i join outer_part o on i.t = o.s)
select *, folded_root = root as verified from done
"""


@query("op12_merkle_manifest", merkle_sql())
def op12(table):
    found = merkle.manifest(table("documents"), remainder("doc_id", 5) == 0)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_pack_sequences")
def op13(table):
    cut = packing.pieces(table("documents"), f"{TOKENIZERS}/{VOCABULARY}")
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(slim)
