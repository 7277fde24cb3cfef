from __future__ import annotations

import random

import numpy as np

from webstrata.llm import wordhash as W


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_words_that_break_polynomials():
    """A Thue-Morse word and its mirror differ, whatever their length; as one-word texts their sets do, too."""
    for n in (64, 1024, 4096):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        got, bound = W.batch_words([a.encode(), b.encode(), a.encode()])
        assert got[0] != got[1] and got[0] == got[2] and bound.tolist() == [0, 1, 2, 3]
        sets = W.shingle_sets([a.encode(), b.encode()])
        assert sets[0][0] != sets[1][0]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    """In any chunk and text; A-Z are folded on demand; words of many lengths do not meet."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abABé") for _ in range(draw.randint(1, 12))) for _ in range(20_000)]
    for fold in (True, False):
        key = (lambda w: w.translate({c: c + 32 for c in range(65, 91)})) if fold else (lambda w: w)
        known: dict = {}
        for text in (" ".join(words), "x" * (1 << 20) + "\n" + "\t ".join(reversed(words))):
            got, start, end = W.words(text.encode(), fold)
            raw = text.encode()
            for h, a, b in zip(got.tolist(), start.tolist(), end.tolist(), strict=True):
                assert known.setdefault(key(raw[a:b].decode()), h) == h
        assert len(set(known.values())) == len(known)
    assert W.words(b"")[0].dtype == np.uint64 and len(W.words(b" \n")[0]) == 0
