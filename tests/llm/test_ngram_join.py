from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from webstrata.llm import components as C
from webstrata.llm import ngram_join as N
from webstrata.llm import wordhash as W


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """{row number: (size, component)}; rows: (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    near = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            near[g].append(i)
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    seen = set()
    for members in near.values():
        for x in range(len(members)):
            for y in range(x):
                seen.add((members[y], members[x]))
    for a, b in seen:
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            home[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], len(sets[k]), least[find(k)] if sets[k] else rows[k][0]) for k in range(len(rows)))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, set_id string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.join_documents(df).collect())


def words(rnd, n, vocab=5000):
    return [f"w{rnd.randrange(vocab)}" for _ in range(n)]


def edit(rnd, text, share):
    return [w if rnd.random() > share else f"e{rnd.randrange(10**6)}" for w in text]


@pytest.fixture
def corpus():
    """Copies, near copies around the threshold, chains, a common passage, short texts, edge cases."""
    rnd = random.Random(11)
    texts = []
    for size in (6, 7, 9, 12, 30, 120, 400):
        base = words(rnd, size)
        texts += [base, base] + [edit(rnd, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06)]
        texts += [base + words(rnd, k) for k in (1, 2, size // 4, size // 3)] + [base[: -(size // 5) or None], base[: size // 2]]
    chain = words(rnd, 200)
    for k in range(12):
        texts.append(chain[8 * k :] + words(rnd, 8 * k))
    passage = words(rnd, 60)
    texts += [passage + words(rnd, rnd.randrange(1, 80)) for _ in range(60)]
    big = words(rnd, 90)
    texts += [edit(rnd, big, 0.03) for _ in range(80)]  # a group of near copies that don't all link
    rows = [" ".join(t) for t in texts]
    rows += [None, "", " \n\t", "One", "one", "ONE two", "a b c d", "A B c d", "x y z w v", "\u00a0x y\x0bz", "É é", "é É", "w " * 30_000, "w " * 30_001]
    rnd.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def test_against_brute_force(spark, corpus):
    assert run(spark, corpus) == brute(corpus)


def test_small_frequency_classes(spark, corpus, monkeypatch):
    """With almost all repeated tokens frequent, links come from combinations."""
    monkeypatch.setattr(N, "LEAST_FREQUENT", 2)
    assert run(spark, corpus) == brute(corpus)
    monkeypatch.setattr(N, "MOST_FREQUENT", 0)  # and with none
    assert run(spark, corpus) == brute(corpus)


def test_blocks(spark, corpus, monkeypatch):
    """Large buckets dealt into blocks give the same."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "SIDE", 3)
    monkeypatch.setattr(N, "SMALL", 0)
    assert run(spark, corpus) == brute(corpus)


@pytest.mark.parametrize("most", [2, 3, 5, 50])
def test_cut_buckets(spark, most):
    """Sets of a bucket that is cut are compared over its parts; copies are no sets of their own."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = {1: range(10, 15), 2: range(20, 23), 3: range(30, 37), 4: range(40, 41), 5: range(50, 70)}
    rows = [(sig, k) for sig, ids in sets.items() for k in ids for _ in range(9)]
    entries = spark.createDataFrame(rows, "sig long, set_id long").coalesce(1)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = [tuple(r) for r in N.candidates(entries, most).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    members = [(a, b) for kind, a, b in found if kind == N.MEMBER]
    assert len(members) == len(set(members))
    pairs = {(a, b) for kind, a, b in found if kind == N.PAIR}
    for sig, ids in sets.items():
        assert {(ids[0], k) for k in ids[1:]} <= pairs
        all_pairs = {(a, b) for a in ids for b in ids if a < b}
        assert all_pairs <= pairs or {b for a, b in members if a == sig} == set(ids)
        if len(ids) > N.FEW:
            assert {b for a, b in members if a == sig} == set(ids)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "Q R S T U V"), (3, "z"), (3, "z"), (4, None)]
    assert run(spark, rows) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 1, 3), (4, 0, 4)]
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.join_documents(df).collect()), key=repr) == sorted([(None, 1, None), (5, 1, 5), (None, 0, None)], key=repr)
    assert N.join_documents(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in N.one_of_each(df).collect()) == [0, 0, 5]


def test_one_of_each_judges_rows(spark):
    """Rows that repeat an id are judged by their own texts; columns named like the operator's own stay."""
    a, other, third = "a b c d e f g h i j k l m n o p", "q r s t u v", "x y z w v u"
    rows = [(1, a, 10), (5, a + " q", 11), (5, other, 12), (5, other, 13), (7, other, 14), (8, third, 15), (8, third, 16), (9, None, 17), (5, None, 18), (None, a, 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, set_id long").repartition(3)
    for few in (N.SMALL, 0):
        N.SMALL, kept = few, N.SMALL
        try:
            got = N.one_of_each(df)
            assert got.columns == df.columns and sorted(r.set_id for r in got.collect()) == [10, 12, 13, 15, 16, 17, 18, 19]
        finally:
            N.SMALL = kept


def test_session_is_left_alone(spark, corpus):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    run(spark, corpus[:20])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_small_batches():
    import pyarrow as pa

    from webstrata.llm import common

    texts = ["x" * (k % 7) for k in range(3000)] + ["y" * (3 << 20)] * 7 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(common.small_batches(iter([batch, batch.slice(0, 0)])))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= common.BATCH_ROWS and (p.num_rows == 1 or p.nbytes <= common.BATCH_BYTES) for p in parts)


def test_scratch_is_removed(spark):
    import os

    from webstrata.llm import common

    with common.scratch(spark):
        path = common.shared_dir(spark, "x")
        spark.range(3).write.parquet(path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.join_documents(docs).collect()) == brute(rows)


def test_hashes():
    long = b"word " * 400_000 + b"end"
    h, start, end = W.words(long)
    assert len(h) == 400_001 and len(set(h[:-1].tolist())) == 1 and (end - start)[-1] == 3
    one = b"x" * 3_000_000 + b" y"
    assert len(W.words(one)[0]) == 2
    a = W.shingle_sets([b"A b\tc d E f", b"a B c D e F", b"", b"a b", b"b a"])
    assert (a[0] == a[1]).all() and len(a[2]) == 0 and len(a[3]) == 1 and a[3][0] != a[4][0]
    sets = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, 500).astype(np.uint64)) for k in range(2)]
    differ = np.bitwise_count(np.frombuffer(N.sketch(sets[0]), np.uint8) ^ np.frombuffer(N.sketch(sets[1]), np.uint8)).sum()
    assert differ <= len(np.setxor1d(*sets))


def test_long_word_after_a_space():
    long = b"x" * (3 << 20)
    alone, _, _ = W.words(long)
    for before in (b"", b" ", b"a ", b"\n"):
        found, start, end = W.words(before + long + b" b")
        assert len(found) == len(before.split()) + 2 and found[-2] == alone[0]
        assert (start[-2], end[-2]) == (len(before), len(before) + len(long))


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001), (5000, 5000)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}
