from __future__ import annotations

import hashlib
import re

from webstrata.llm.exact_dedup import DigestIndex, dedup_documents, exact_dedup

TEXTS = [(5, "a  b"), (2, "a\tb"), (9, None), (4, ""), (7, "ünïcode\n\nx"), (7, "ünïcode\n\nx"), (8, "ünïcode x "), (None, "a b"), (3, "\u00a0"), (6, " " * 50)]


def want(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, (_, t) in enumerate(rows)}
    out = []
    for i, (d, _) in enumerate(rows):
        group = [rows[j][0] for j in norm if norm[j] == norm[i]]
        keep = min((g for g in group if g is not None), default=None)
        out.append((d, keep, len(group), d == keep, hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=repr)


def docs(spark, rows):
    # an extra column whose name clashes with one inside
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, digest string")


def test_against_brute_force(spark):
    for arrivals in (1, 3):
        got = exact_dedup(docs(spark, TEXTS), DigestIndex(spark, buckets=4), arrivals=arrivals)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want(TEXTS)
    assert exact_dedup(docs(spark, []), DigestIndex(spark)).count() == 0


def test_persistent_index(spark):
    index = DigestIndex(spark, buckets=4)
    assert {r.doc_id for r in dedup_documents(docs(spark, [(1, "x"), (2, "x"), (3, "y")]), index).collect()} == {1, 3}
    assert {r.doc_id for r in dedup_documents(docs(spark, [(0, "x"), (4, "z"), (4, "z"), (5, "z ")]), index).collect()} == {4, 5}
    assert index.read().count() == 4
    late = exact_dedup(docs(spark, [(9, "x"), (10, "new")]), index)
    assert {(r.doc_id, r.keep_id, r.kept) for r in late.collect()} == {(9, 1, False), (10, 10, True)}
    index.drop()


def test_an_arrival_that_is_run_again(spark):
    """Under its name it gives the same rows and adds nothing twice; other arrivals see its texts."""
    index = DigestIndex(spark, buckets=4)
    first, second = docs(spark, [(1, "x"), (2, "x"), (3, "y")]), docs(spark, [(7, "y"), (8, "z")])
    for _ in range(2):
        assert {r.doc_id for r in dedup_documents(first, index, "monday").collect()} == {1, 3}
    for _ in range(2):
        assert {r.doc_id for r in dedup_documents(second, index, "tuesday").collect()} == {8}
    assert dedup_documents(second, index).count() == 0 and index.read().count() == 3
    index.compact()
    assert index.read().count() == 3 and dedup_documents(docs(spark, [(9, "z"), (10, "new")]), index).count() == 1
    index.drop()


def test_columns_with_the_names_inside_stay(spark):
    df = spark.createDataFrame([(1, "x", "a", "b", "c"), (2, "x", "d", "e", "f"), (3, "y", "g", "h", "i")], "doc_id long, text string, _digest string, digest string, told string")
    index = DigestIndex(spark, buckets=4)
    assert sorted(tuple(r) for r in dedup_documents(df, index).collect()) == [(1, "x", "a", "b", "c"), (3, "y", "g", "h", "i")]
    index.drop()
