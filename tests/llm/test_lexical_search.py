from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL, rows
from webstrata.llm import lexical_search as S
from webstrata.llm import queries

TERM = re.compile(S.TERM)


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    """The definition, written out: docs and items are (id, text)."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            size = sum(c.values())
            score = 0
            for t, times in terms.items():
                if c[t]:
                    m = 100 - 75 + 75 * size * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def made(draw, n, words=40, most=30):
    weights = [1 / (k + 1) for k in range(words)]
    return [(k, " ".join(f"w{x}" for x in draw.choices(range(words), weights, k=draw.randint(0, most)))) for k in range(n)]


@pytest.mark.parametrize(("size", "short", "seed"), [(16, 4, 1), (16, 32, 2), (64, 2, 3), (512, 32, 4)])
def test_segments_find_what_the_definition_says(monkeypatch, size, short, seed):
    """Many segments, ranges and skips in one process; many ties, repeated and null ids."""
    monkeypatch.setattr(S, "RANGE", size)
    monkeypatch.setattr(S, "SHORT", short)
    draw = random.Random(seed)
    docs = [(draw.choice([None, i % 700]) if draw.random() < 0.05 else i % 700, t) for i, t in made(draw, 900)]
    items = made(draw, 25, most=12)
    terms = sorted({t.encode() for _, x in items for t in terms_of(x)})
    number = {t: k for k, t in enumerate(terms)}
    segment, parts = S.Builder(), []
    for i, t in docs:
        found = [number.get(x.encode(), -1) for x in terms_of(t)]
        segment.add(i, len(found), np.array([x for x in found if x >= 0], np.int32))
        if len(segment.ids) == 170:
            parts.append(segment.close())
    parts.append(segment.close())
    assert parts[-1].num_rows == 1
    n, total = (sum(p.column(c)[0].as_py() for p in parts) for c in (0, 1))
    held = [row for p in parts for row in S.segments_of(p.select(range(2, 8)))]
    df = np.zeros(len(terms), np.int64)
    for row in held:
        np.add.at(df, row["term"], row["df"])
    weights = np.array([S.weight(n, int(x)) if x else 0 for x in df])
    got = []
    for i, t in items:
        best, own = S.Best(10), Counter(number[x.encode()] for x in terms_of(t))
        own = [x for x in sorted(own.items()) if weights[x[0]] > 0]
        for row in held:
            S.Segment(row, weights, n, total).search(np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64), best)
        got += [(i, k + 1, None if null else int(d), int(s)) for k, (s, null, d) in enumerate(zip(best.score, best.null, best.id, strict=True))]
    assert sorted(got, key=repr) == brute(docs, items)


def test_ranges_are_skipped(monkeypatch):
    """Once ten documents have both terms, documents with the frequent term alone are not looked at."""
    monkeypatch.setattr(S, "RANGE", 16)
    segment = S.Builder()
    for i in range(2000):
        segment.add(i, 5, np.array([0, 1, 1] if i < 12 else [0], np.int32))
    row = next(S.segments_of(segment.close().select(range(2, 8))))
    seen = []
    one = S.Segment.search_range
    monkeypatch.setattr(S.Segment, "search_range", lambda self, r, *a: (seen.append(r), one(self, r, *a))[1])
    best = S.Best(10)
    S.Segment(row, np.array([10, 5000]), 2000, 10_000).search(np.array([0, 1]), np.array([1, 1]), best)
    assert seen == [0] and best.id.tolist() == list(range(10))


def test_sizes_that_pass_64_bits():
    assert S.lengths_of(np.array([4_000_000_000_000]), 10**9, 5 * 10**13).tolist() == [25 + 75 * 4_000_000_000_000 * 10**9 // (5 * 10**13)]


def test_query_over_the_whole_table(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(queries.op13_lexical_search(spark, SMALL)) == brute(docs, items)


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows and items, ties, clashing extra columns, several blocks, empty tables."""
    long = "alpha " + "beta gamma. " * 80_000
    docs = [(1, "Alpha beta"), (2, "alpha BETA"), (2, "alpha BETA"), (None, "alpha beta"), (3, None), (4, ""), (5, long), (6, "ÄB äb épsilon-7"), (7, "!!! ...")]
    items = [(1, "alpha"), (1, "beta"), (2, "äb ÄB 7"), (None, "gamma gamma"), (3, None), (4, "nowhere"), (5, "...")]
    left = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, item_id int, score int")
    right = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, rank int")
    want = brute(docs, items)
    assert [x[2] for x in want if x[0] == 1][:5] == [1, 2, 2, None, 5]
    assert rows(S.search(left, right)) == want == rows(S.search(left, right, block_pairs=1))
    assert rows(S.search(left, right, k=2)) == brute(docs, items, 2)
    assert S.search(left.limit(0), right).count() == S.search(left, right.limit(0)).count() == 0
    assert S.search(left, right).columns == ["item_id", "rank", "doc_id", "score"]
