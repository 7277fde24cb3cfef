from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from webstrata.llm import mixing as M
from webstrata.llm import packing as P

SCHEMA = "doc_id long, text string, source string, taken string, n_chars long"


def water(sizes: dict, epochs=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, total = {}, set(names), sum(sizes.values())
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(epochs * sizes[s])
            open_.discard(s)
    return target


def docs(spark, plan):
    return spark.createDataFrame([(i, t, s, "x", len(t or "")) for i, t, s in plan], SCHEMA)


def test_mix(spark):
    plan = [(k, "w " * (k % 37), "big") for k in range(400)] + [(1000 + k, "w " * 30, None) for k in range(40)] + [(2000, "a b c", "tiny"), (2001, None, "tiny"), (2002, "", "none"), (None, "x y", "big"), (3000, "w " * 5000, "long"), (3000, "w " * 5000, "long")]
    df = docs(spark, plan)
    got = M.mix(df).collect()
    assert len(got) == len(plan)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = water(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1 and {r.source_size for r in got if r.source == s} == {sizes[s]}
    again = M.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)
    assert M.mix(df.limit(0)).count() == 0


def test_mixed_documents(spark):
    df = docs(spark, [(k, " ".join(f"w{k}x{j}" for j in range(20)), "a" if k % 4 else "b") for k in range(80)])
    taken = {r.doc_id: r.taken for r in M.mix(df).collect()}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words, n = defaultdict(int), defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        n[r.doc_id] += 1
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v} and max(n.values()) <= 3


ODD = [(k, " ".join(f"w{k}x{j}" for j in range(k % 23)), "hot") for k in range(300)] + [(1000 + k, f"\ta{k}  b c\n d e f", f"s{k % 9}") for k in range(60)]
ODD += [(2000, None, "hot"), (2001, " \n", "none"), (2002, "x y z", None), (None, "one two", "hot"), (None, "three", "hot"), (None, None, None), (3000, "p q r s", "s1"), (3000, "p q r s", "s1"), (3001, "p q", "s2"), (3001, "p q r s t u", "s2")]


@pytest.mark.parametrize("small", [None, 0])
def test_mixed_documents_follow_the_plan(spark, small, monkeypatch):
    """Rows and parts against the plan, row by row: hot, small, null and empty sources, rows without words, repeated rows and ids; both joins."""
    if small is not None:
        monkeypatch.setattr(M, "SMALL", small)
    df = docs(spark, ODD)
    taken = defaultdict(list)
    for r in M.mix(df, block=16).collect():
        taken[r.doc_id, r.source, r.size].append(r.taken)
    want = []
    for key in {(i, s, len((t or "").split())) for i, t, s in ODD}:
        texts = [t for i, t, s in ODD if (i, s, len((t or "").split())) == key]
        for text, n in zip(texts, taken[key], strict=True):
            words = (text or "").split()
            if words:
                want += [(key[0] or -1, key[1] or "", text)] * (n // len(words))
            if words and n % len(words):
                want.append((key[0] or -1, key[1] or "", " ".join(words[: n % len(words)])))
    got = M.mixed_documents(df, block=16)
    assert got.columns == df.columns and sorted((r.doc_id or -1, r.source or "", r.text) for r in got.collect()) == sorted(want)
    assert M.mixed_documents(df.limit(0)).count() == 0


def test_columns_with_the_names_inside_stay(spark):
    df = spark.createDataFrame([(k, f"a b {k}", "s", "x", "y", k, "z") for k in range(5)], "doc_id long, text string, source string, key string, _key string, slot long, in_0 string")
    got = M.mixed_documents(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in df.collect()}


def evenness(keys, share, stretch):
    """The largest difference, in slots, of a source's count in a stretch of the mix to its share."""
    return max(abs(keys[at : at + stretch].count(k) - share[k] * stretch) for at in range(0, len(keys) - stretch, stretch) for k in share)


def even_docs(spark):
    return docs(spark, [(k, " ".join(f"w{k}x{j}" for j in range(8)), "abc"[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2]) for k in range(2000)])


def test_mix_is_even(spark, monkeypatch):
    """Any stretch of what comes out has each source about as often as its share; without the schedule's points it has not."""
    df = even_docs(spark)
    total = {r.source: r.target for r in M.mix(df).select("source", "target").distinct().collect()}
    share = {s: t / sum(total.values()) for s, t in total.items()}
    out = [r.source for r in M.mixed_blocks(df, block=8).collect()]
    assert evenness(out[: int(0.9 * len(out))], share, 100) <= 5
    laid = [r.source for r in M.mixed_documents(df, block=8).collect()]
    assert evenness(laid[: int(0.9 * len(laid))], share, 100) <= 5
    slots = sorted((r.doc_id, r.first_slot) for r in M.mix(df, block=8).collect())
    monkeypatch.setattr(M, "GOLDEN", 0)
    assert evenness([r.source for r in M.mixed_blocks(df, block=8).collect()], share, 100) > 20
    assert sorted((r.doc_id, r.first_slot) for r in M.mix(df, block=8).collect()) != slots


def test_blocks_hold_the_taken_words(spark):
    """Blocks against the words of the documents: each piece is where it says, and together they are what the mix takes."""
    df = docs(spark, ODD)
    words = defaultdict(set)
    for i, t, s in ODD:
        words[i, s].add(tuple((t or "").split()))
    taken = defaultdict(int)
    last, fill = -1, defaultdict(int)
    for r in M.mixed_blocks(df, block=16).collect():
        assert r.slot >= last and any(list(w[r.start : r.start + r.words]) == r.text.split() and r.words > 0 for w in words[r.doc_id, r.source])
        last = r.slot
        fill[r.slot] += r.words
        taken[r.doc_id, r.source] += r.words
    want = defaultdict(int)
    for r in M.mix(df, block=16).collect():
        want[r.doc_id, r.source] += r.taken
    assert max(fill.values()) <= 16 and taken == {k: v for k, v in want.items() if v}


def test_schedule_is_even(spark):
    """Any stretch of the schedule has each source about as often as its share."""
    src = spark.createDataFrame([("sa", "a", 6000, 6000.0), ("sb", "b", 3000, 3000.0), ("sc", "c", 1000, 1000.0)], "key string, source string, source_size long, target double")
    slots = [r.key for r in M.schedule(spark, src, 10).orderBy("slot").collect()]
    for at in range(0, 1000, 100):
        part = slots[at : at + 100]
        assert abs(part.count("sa") - 60) <= 4 and abs(part.count("sb") - 30) <= 4


def check_packed(spark, df, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append(slow.encode(r.text or "", add_special_tokens=False).ids + [1])
    got = P.pack(df, window).collect()
    fill, cover = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
        cover[r.doc_id] += r.length
        mine = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in mine)
    assert cover == {d: sum(map(len, x)) for d, x in ids.items()} and max(fill.values(), default=0) <= window
    return len(fill), sum(fill.values())


def test_packing(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    n, total = check_packed(spark, df, 2048)
    assert n <= 1.02 * total / 2048 + 1
    odd = docs(spark, [(1, None, "s"), (2, "", "s"), (3, "x <|endoftext|> y<|endoftext|><|endoftext|", "s"), (None, "abc", "s"), (4, "same", "s"), (4, "same", "s"), (5, "lorem " * 9000, "s"), (6, "a" * 5000, "s"), (7, "é😀\u2003\r\n\r\n  tail  ", "s")])
    check_packed(spark, odd, 64)
    assert P.pack(odd.limit(0)).count() == 0


def test_plan_uses_every_piece():
    rnd = np.random.default_rng(3)
    for n in (1, 10, 5000):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(rnd.lognormal(4, 1, n).astype(int) + 1, 256), return_counts=True), strict=True)}
        used = defaultdict(int)
        sequences = 0
        for combo, times in P.plan(histogram, 256):
            assert sum(combo) <= 256 and times > 0
            sequences += times
            for length in combo:
                used[length] += times
        assert used == histogram
    assert sequences <= 1.01 * sum(k * v for k, v in histogram.items()) / 256 + 1


def test_nnls():
    """Against the exact solution where combinations don't overlap and where they compete."""
    have = np.zeros(11)
    have[[3, 7, 5]] = 4, 6, 10
    x = P.repeat_counts([(7, 3), (5, 5)], have)
    assert x == pytest.approx([5.0, 5.0], abs=0.3)
