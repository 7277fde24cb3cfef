from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL, rows
from webstrata.llm import collocations as C
from webstrata.llm import queries


def brute(docs, threshold, top=2000):
    """The definition, written out: docs are (lang, text)."""
    counts: dict[str, Counter] = {}
    for lang, text in docs:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {k: v for k, v in f.items() if len(k) > 1 and v >= threshold}
        gone = {k[i : i + m] for k, v in found.items() for m in range(2, len(k)) for i in range(len(k) - m + 1) if v >= f[k[i : i + m]]}
        ranked = []
        for k, a in found.items():
            if k not in gone:
                score, _, left, right = min((1000 * a * n // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
                ranked.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out, key=repr)


def made(draw, n):
    words = [f"w{k}" for k in range(60)] + ["Über", "straße", "<a>"]
    weights = [1 / (k + 1) for k in range(len(words))]
    fixed = ["in spite of the", "as well as", "in spite of", "New York City"]
    out = []
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.1 else draw.choices(words, weights)[0] for _ in range(draw.randint(0, 40))]
        text = "".join(p + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)
        out.append((draw.choice(["en", "en", "de", None, "und"]), text))
    return out


def test_summaries_keep_every_frequent_key():
    """However rows are dealt and merged, keys of the threshold survive, and counters stay below the capacity."""
    draw = np.random.default_rng(1)
    for capacity_over in (1, 50):
        keys = draw.zipf(1.3, 200_000) % 50_000
        threshold = 400
        true = Counter(keys.tolist())
        capacity = len(keys) // threshold + capacity_over
        parts = []
        for own in np.array_split(keys, 7):
            summary = C.MisraGries(capacity)
            for some in np.array_split(own, 9):
                key, count = np.unique(some, return_counts=True)
                summary.add(key, count)
                summary.fold()
                assert len(summary.key) <= capacity
            parts.append(summary)
        whole = parts[0]
        for other in parts[1:]:
            whole.merge(other)
        assert 0 < whole.lost <= len(keys) / (capacity + 1) < threshold
        found = dict(zip(whole.key.tolist(), whole.count.tolist(), strict=True))
        assert all(found.get(k, 0) <= n <= found.get(k, 0) + whole.lost for k, n in true.items())
        assert {k for k, n in true.items() if n >= threshold} <= set(whole.survivors(threshold).tolist())
        assert len(whole.key) <= capacity < len(true)


@pytest.mark.parametrize(("bits", "parts", "threshold"), [(26, 3, 5), (6, 7, 12), (14, 1, 3)])
def test_same_as_the_definition(spark, bits, parts, threshold):
    """Also where bitmaps are so small that all their bits are set."""
    docs = made(random.Random(bits), 400)
    got = C.collocations(spark.createDataFrame(docs, "lang string, text string"), threshold, bits=bits, parts=parts)
    want = brute(docs, threshold)
    assert rows(got) == want and len(want) > 40


def test_top_and_edges(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing extra columns, an empty table."""
    docs = [("en", None), ("en", ""), (None, "a b. a b"), ("und", "A  B"), ("fr", ". , ;"), ("de", "x y z " * 50_000), ("es", "p q, r s, p q, r s"), ("es", "p q, r s, p q, r s")]
    df = spark.createDataFrame([(k % 3, *x, 1) for k, x in enumerate(docs)], "doc_id int, lang string, text string, n int")
    assert rows(C.collocations(df, 3)) == brute(docs, 3)
    assert rows(C.collocations(df, 3, top=1)) == brute(docs, 3, 1)
    assert C.collocations(df.limit(0)).count() == 0 and C.collocations(df.limit(1)).count() == 0


def test_query_over_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()]
    assert rows(queries.op11_collocations(spark, SMALL)) == brute(docs, 100)
