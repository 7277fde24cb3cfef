"""64-bit hashes of words and of word n-grams, vectorised over the bytes of many texts."""

from __future__ import annotations

import numpy as np

#: Odd multipliers and the step of the generator below.
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
#: The five code units \x09-\x0D and the space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in bytes) of each word. Long inputs go in chunks that end at white space."""
    found, at, size = [], 0, len(data)
    buf = np.frombuffer(data, np.uint8)
    while at < size:
        to = min(size, at + CHUNK)
        if to < size and not SPACE[buf[to]]:
            gap = np.flatnonzero(SPACE[buf[at:to]])
            if len(gap) and gap[-1]:
                to = at + int(gap[-1])
            else:  # one word longer than a chunk, perhaps after the white space that the chunk starts with
                while to < size and not SPACE[buf[to]]:
                    to += 1
        found.append(_chunk(buf[at:to], at, fold))
        at = to
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chunk(buf: np.ndarray, base: int, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word's hash is the sum over its bytes of byte and place in the word, mixed together before they are summed:
    no structure of words (as that of polynomials modulo a power of two) makes two of them equal."""
    inside = ~SPACE[buf]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at, size = np.flatnonzero(inside), end - start
    place = (at - np.repeat(start, size)).astype(np.uint64)
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(mix(BYTE[FOLD[buf[at]] if fold else buf[at]] + place * BASE), out=total[1:])
    upto = np.cumsum(size)
    value = total[upto] - total[upto - size]
    return mix(value ^ size.astype(np.uint64)), start + base, end + base


def batch_words(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts, and for text i the range [bound[i], bound[i + 1]) of its words."""
    hashes, start, _ = words(b"\n".join(texts), fold)
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return hashes, np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row; one less by one than the words for each further n."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total + hashes[k : len(hashes) - n + 1 + k] + STEP)
    return total


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a shorter text is one shingle, an empty one none."""
    hashes, bound = batch_words(texts)
    grams, out = windows(hashes, n), []
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short + hashes[k : k + 1] + BASE)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out
