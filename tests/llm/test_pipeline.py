"""The pipeline and the registered queries on the smallest tables."""

import importlib
import os
import re

import pytest

import __spark_entry__ as entry
from keepsake.llm import decontam, jaccard, line_dedup, queries
from keepsake.session import settle
from test_operators import alnum, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = con.execute(queries.ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted(map(repr, rows.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == expected


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = queries.read(spark, SF, "documents")
    columns = docs.columns
    good = {r.doc_id: r.quality for r in queries.read(spark, SF, "labels").collect()}
    seen = []
    for name, stage in pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF), name)
        seen.append((name, before.count(), docs.count()))
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            assert sum(i in kept for i, q in good.items() if q == 1) > 0.95 * sum(good.values())
        if name == "near_duplicates":
            assert jaccard.link(docs).filter("component_id <> doc_id").count() == 0
        if name == "decontamination":
            windows = {tuple(w[k:k + 10]) for (t,) in queries.read(spark, SF, "benchmark").select("text").collect()
                       for w in [alnum(t)] for k in range(max(1, len(w) - 9))}
            clean = {r.doc_id for r in docs.collect()}
            for r in before.collect():
                w = alnum(r.text)
                assert (r.doc_id in clean) == (not any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9)))
        if name == "mixing":
            assert all(r.size == len(words(t)) for r, t in zip(docs.orderBy("doc_id").collect(), [x.text for x in before.orderBy("doc_id").collect()]))
    assert all(a >= b for _, a, b in seen), seen


def test_stages_take_empty_tables(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = queries.read(spark, SF, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_pass_on_columns_of_any_name(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = settle(queries.read(spark, SF, "documents"), "plain")
    names = ["c", "d", "gone", "score", "c0", "n_removed", "n_lines", "content", "key", "place", "spot", "other", "row", "label", "x", "scored_text"]
    wide = settle(docs.selectExpr("*", *(f"concat('{n}', doc_id) as {n}" for n in names)), "wide")
    for name, stage in pipeline.STAGES:
        docs, wide = settle(stage(spark, docs, SF), name), settle(stage(spark, wide, SF), name)
        if name == "mixing":
            names = []
        assert wide.columns == docs.columns + names
        assert sorted(map(repr, wide.select(*docs.columns).collect())) == sorted(map(repr, docs.collect())), name
        assert not names or wide.filter(" or ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).count() == 0


def test_stages_take_nulls_repeats_and_long_texts(spark):
    """Null and repeated ids, null and empty texts, rows alike, and a text of one word 20,000 times."""
    pipeline = importlib.import_module("corpus_pipeline")
    some = settle(queries.read(spark, SF, "documents").limit(60), "some")
    odd = some.selectExpr("cast(null as bigint) as doc_id", "concat('no id ', text) as text", "lang", "cast(null as string) as source", "n_chars")
    odd = odd.union(some.selectExpr("7 as doc_id", "cast(null as string) as text", "lang", "source", "cast(null as bigint) as n_chars"))
    odd = odd.union(some.selectExpr("8 as doc_id", "''", "lang", "source", "0")).union(some.selectExpr("doc_id", "text", "lang", "source", "n_chars"))
    odd = odd.union(some.limit(1).selectExpr("900001 as doc_id", "repeat('word ', 20000)", "lang", "source", "100000"))
    docs = settle(some.select("doc_id", "text", "lang", "source", "n_chars").union(odd), "odd")
    for name, stage in pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF), name)
        assert 0 < docs.count() <= before.count()
        if name not in ("quality", "mixing"):
            nulls = "text is null"
            assert docs.filter(nulls).count() == before.filter(nulls).count()
