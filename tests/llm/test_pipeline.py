from __future__ import annotations

import re

import pytest

from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute as components

pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    known = stage["language_id"](spark, docs, SMALL).cache()
    assert known.columns == docs.columns and known.count() >= 0.99 * docs.count()
    distinct = stage["exact_dedup"](spark, known, SMALL).cache()
    first = {}
    for r in known.collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[text] = min(first.get(text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(first.values())
    near = stage["ngram_join"](spark, distinct, SMALL).cache()
    want = sorted(d for d, _, c in components([(r.doc_id, r.text) for r in distinct.collect()]) if d == c)
    assert sorted(r.doc_id for r in near.collect()) == want
    mixed = stage["mixing"](spark, near, SMALL).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(want)
    packed = stage["packing"](spark, mixed, SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_run(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SMALL).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Null and empty texts, null ids and sources, repeated rows, extra columns with names that operators use: each stage keeps the columns."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, "the cat and the dog", "en", None, 3), (90_001, None, None, None, 0), (90_002, "", "en", "s", 0), (90_003, "a b c d e f", "en", "s", 1), (90_003, "a b c d e f", "en", "s", 1)], docs.schema)
    more = docs.unionByName(odd).selectExpr("*", "1 as size", "2L as component_id", "'x' as keep_id", "true as kept", "0.5D as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows_in in (more, more.limit(0)):
            out = stage(spark, rows_in, SMALL)
            assert out.columns == more.columns, name
            assert out.count() >= 0 and (rows_in is more or out.count() == 0), name
    kept = {r.doc_id for r in corpus_pipeline.distinct_text(spark, more, SMALL).where("doc_id > 90000").collect()}
    assert kept == {90_001, 90_003}
    near = corpus_pipeline.one_of_near_copies(spark, more, SMALL).where("doc_id > 90000").groupBy("doc_id").count().collect()
    assert {(r[0], r[1]) for r in near} == {(90_001, 1), (90_002, 1), (90_003, 2)}
    pieces = corpus_pipeline.packed(spark, more, SMALL)
    assert pieces.where("doc_id = 90001").first().length == 1 and corpus_pipeline.packed(spark, more.limit(0), SMALL).count() == 0
