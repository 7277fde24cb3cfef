from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SMALL, rows
from webstrata.llm import byte_bpe as B
from webstrata.llm import queries


@pytest.fixture(scope="module")
def theirs():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queue_gives_ranks_in_order():
    draw, queue, held = random.Random(7), B.RankQueue(60_000), {}
    for _ in range(3000):
        if draw.random() < 0.6 or not held:
            rank = draw.choice([draw.randrange(60_000), draw.randrange(70), 4095, 4096, 59_999])
            if rank in held:
                queue.buckets[rank].append(len(held))
                held[rank].append(len(held))
            else:
                queue.put(rank, [5, 3])
                held[rank] = [3, 5]
        else:
            assert queue.first() == min(held)
            assert queue.take(min(held)) == sorted(held.pop(min(held)))
    while held:
        assert queue.first() == min(held)
        queue.take(min(held))
        del held[min(held)]
    assert queue.first() == -1
    with pytest.raises(ValueError):
        B.RankQueue(300_000)


def test_same_ids_as_the_library(theirs):
    """Random texts of letters, white space, contractions, marks and any code points, alone and many in a batch."""
    draw, words = random.Random(1), B.vocabulary()
    alphabet = "aab bcd  eé\n\t'sre 12,.Ո՘࢏\U0001e5f1\U00011bc0ñ字字 \xa0\x85\x1c " + "<|endoftext|>"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0xD7FF), draw.randint(0xE000, 0x10FFFF), draw.randint(32, 700)])) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    texts += ["", " ", "  ", "\n\n", "a", "It's we'll THEY'RE", "x" * 47 + "y", " " + "z" * 48]
    assert [x.tolist() for x in words.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
    assert all(words.decode(x) == t.encode() for x, t in zip(words.encode(texts[:500]), texts, strict=False))


def test_every_code_point_is_split_as_by_the_library(theirs):
    """Of each code point, whether it goes with a letter, a digit or a mark before it."""
    words = B.vocabulary()
    points = [c for c in [*range(0xD800), *range(0xE000, 0x110000)] if c < 0x3000 or c % 5 == 0 or B.vocabulary().is_late[c]]
    for before in "a1!":
        texts = [f"{before}{chr(c)}" for c in points]
        assert [x.tolist() for x in words.encode(texts)] == theirs.encode_ordinary_batch(texts)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_001 + "x", "ab" * 100_000, "字" * 50_000, "=-" * 60_000])
def test_very_long_pre_tokens(theirs, text):
    assert B.vocabulary().encode([text])[0].tolist() == theirs.encode_ordinary(text)


def test_merges_go_to_a_lower_rank_that_a_merge_opens(tmp_path):
    """Ranks as no trained vocabulary has them: a merge makes a pair of lower rank, which comes before the rest of the bucket."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"dab": 257, b"ab": 258, b"abab": 259, b"cd": 260}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    words = B.Vocabulary(str(path), r"\S+|\s+")

    def brute(piece: bytes) -> list[int]:
        parts = [bytes([x]) for x in piece]
        if piece in ranks:
            return [ranks[piece]]
        while len(parts) > 1:
            best = min(((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    draw = random.Random(3)
    texts = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    assert [x.tolist() for x in words.encode(texts)] == [brute(t.encode()) for t in texts]


def test_memory_is_emptied_and_results_stay(monkeypatch, theirs):
    monkeypatch.setattr(B, "REMEMBERED", 50)
    draw, words = random.Random(5), B.Vocabulary(__import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    for _ in range(30):
        texts = [" ".join(draw.choice("abcdefg") * draw.randint(1, 60) for _ in range(9)) for _ in range(4)]
        assert [x.tolist() for x in words.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
        assert len(words.known) <= 50 and all(len(p) <= B.REMEMBERED_CHARS for p in words.known)


def test_query_over_the_whole_table(spark, theirs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in docs:
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(theirs.decode_bytes(ids))))
    assert rows(queries.op12_byte_bpe(spark, SMALL)) == sorted(want, key=repr)


def test_edges(spark, theirs):
    """Nulls, empty and repeated rows, very long texts, clashing extra columns and an empty table."""
    long = "word and another, " * 60_000
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "Grüße 123", 3), (2, "Grüße 123", 3), (3, long, 4)], "doc_id long, text string, ids int")
    got = rows(B.decode(B.encode(odd)))
    assert [(r[0], bytes(r[2]).decode()) for r in got] == [(1, ""), (2, "Grüße 123"), (2, "Grüße 123"), (3, long), (None, "")]
    assert got[1][1] == theirs.encode_ordinary("Grüße 123") and got[0][1] == got[4][1] == []
    assert got[3][1] == theirs.encode_ordinary(long)
    assert B.decode(B.encode(odd.limit(0))).count() == 0
    assert bytes(B.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].bytes) == b""
    with pytest.raises(Exception, match="null among the ids"):
        B.decode(spark.createDataFrame([(1, [5, None])], "doc_id long, ids array<int>")).collect()
    assert B.vocabulary().decode(np.array([], np.int32)) == b""
