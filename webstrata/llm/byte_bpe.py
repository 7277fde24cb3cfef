"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern; each match (a pre-token) is encoded on
its own. Inside a pre-token the bytes are a linked list. Each pair of neighbours that
the vocabulary can merge lies in the bucket of its rank, and a bitmap of three levels
tells the lowest rank whose bucket is not empty (find first set, three words). A
merge changes two pairs only; their old entries stay in their buckets and are skipped
when they come up. A pre-token of n bytes costs O(n) queue steps beyond the sorting
of buckets, so that one of millions of bytes is no worse than many short ones.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webstrata.llm.common import map_batches, with_text
from webstrata.sources.tables import spread

#: Letters and numbers that Unicode 16.0 added to 15.1 (first and last code point): fixed values. The encoding is defined by
#: a library that knows 16.0; the pattern library here knows more, and the standard library less.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D49), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
)
#: Pre-tokens of at most so many characters are remembered, so many of them; then the memory is emptied.
REMEMBERED_CHARS, REMEMBERED = 48, 1 << 19
#: Texts of code points below this are split by the standard pattern library, which is faster and needs the classes spelled out.
PLAIN = 0x250
_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def plain_pattern(pattern: str, named: dict[str, str]) -> str:
    """``pattern`` with its named classes spelled out, for texts of the code points in ``named``."""
    inside, out, k = False, [], 0
    while k < len(pattern):
        token = next((x for x in (*named, pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]) if pattern.startswith(x, k)))
        if token in named:
            out.append(named[token] if inside else f"[{named[token]}]")
        else:
            inside = token == "[" or inside and token != "]"
            out.append(token)
        k += len(token)
    return "".join(out)


class RankQueue:
    """Buckets of positions by rank, under a bitmap of three levels of 64-bit words (up to 262 144 ranks)."""

    BITS = 6

    def __init__(self, ranks: int):
        if ranks > 1 << 3 * self.BITS:
            raise ValueError(f"{ranks} ranks; the queue holds {1 << 3 * self.BITS}")
        self.top, self.middle, self.leaves = 0, [0] * (1 << self.BITS), [0] * (1 << 2 * self.BITS)
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Opens the bucket of a rank that has none."""
        self.buckets[rank] = positions
        leaf, node = rank >> 6, rank >> 12
        self.leaves[leaf] |= 1 << (rank & 63)
        self.middle[node] |= 1 << (leaf & 63)
        self.top |= 1 << node

    def first(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        top = self.top
        if not top:
            return -1
        node = (top & -top).bit_length() - 1
        word = self.middle[node]
        leaf = node << 6 | (word & -word).bit_length() - 1
        word = self.leaves[leaf]
        return leaf << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Removes the bucket and returns its positions in ascending order."""
        leaf, node = rank >> 6, rank >> 12
        self.leaves[leaf] ^= 1 << (rank & 63)
        if not self.leaves[leaf]:
            self.middle[node] ^= 1 << (leaf & 63)
            if not self.middle[node]:
                self.top ^= 1 << node
        return sorted(self.buckets.pop(rank))


class Vocabulary:
    """Ranks of byte strings, read from lines of base64 bytes and rank; ``tokens`` by rank, and the split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.queue, self.pattern = RankQueue(size), regex.compile(pattern)
        self.pairs = np.full(1 << 16, -1, np.int32)  # the rank of each two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        late = lambda c: unicodedata.category(c)[0] not in "LN" and not any(a <= ord(c) <= b for a, b in UNICODE_16)
        later = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", everything) if late(c)]
        self.is_late, self.as_mark = np.zeros(0x110000, bool), dict.fromkeys(later, "§")
        self.is_late[later] = True
        named = {name: "".join(re.escape(c) for c in everything[:PLAIN] if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
        self.plain = re.compile(plain_pattern(pattern, named))
        self.beyond = re.compile(f"[^{re.escape(everything[0])}-{re.escape(everything[PLAIN - 1])}]")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches, in order; together they are the text."""
        if text.isascii() or not self.beyond.search(text):
            return self.plain.findall(text)
        if self.is_late[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            marked = text.translate(self.as_mark)  # as long as the text, and split as by the older classes
            return [text[m.start() : m.end()] for m in self.pattern.finditer(marked)]
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, as int32. Pre-tokens that are new are merged together; short ones are remembered."""
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set().union(*split)
        known, order = self.known, sorted(new)
        known.update(zip(order, self.merge([p.encode() for p in order]), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in split]
        for p in order:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, as 32-bit integers: the whole, if it has a rank; else merges by ascending rank, leftmost first.

        All pre-tokens are one linked list, in which no pair crosses their bounds, so
        that a bucket serves all of them; they don't touch each other's order.
        """
        ranks, queue = self.ranks, self.queue
        data, bound = b"".join(pieces), np.cumsum([0, *map(len, pieces)])
        n, raw = len(data), np.frombuffer(data, np.uint8)
        first = np.full(n + 1, -1, np.int32)
        if n > 1:
            first[: n - 1] = self.pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ends = np.array([p in ranks for p in pieces], bool)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))  # the neighbours' starts
        for k in np.flatnonzero(ends).tolist():
            first[bound[k] : bound[k + 1]] = -1  # whole pre-tokens need no merge
            after[bound[k]] = int(bound[k + 1])
        first[bound[1:-1] - 1] = -1
        last = np.zeros(n + 1, bool)
        last[bound] = True
        last = last.tolist()
        pair = first.tolist()  # the rank of the pair that starts here, -1 if it can't merge or was merged away
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        for own in np.split(at, np.flatnonzero(np.diff(first[at])) + 1) if len(at) else []:
            queue.put(int(first[own[0]]), own.tolist())
        get, buckets, open_bucket = ranks.get, queue.buckets, queue.put
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: a neighbour was merged since
                gone = after[i]
                end = after[gone]
                after[i] = end
                before[end] = i
                pair[gone] = pair[i] = -1
                lowest = rank
                if not last[end]:
                    r = get(data[i : after[end]])
                    if r is not None:
                        pair[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            open_bucket(r, [i])
                        if r < lowest:
                            lowest = r
                if not last[i]:
                    left = before[i]
                    r = get(data[left:end])
                    if r is None:
                        pair[left] = -1
                    else:
                        pair[left] = r
                        if r in buckets:
                            buckets[r].append(left)
                        else:
                            open_bucket(r, [left])
                        if r < lowest:
                            lowest = r
                if lowest < rank:  # the lower rank comes first, then the rest of this bucket
                    if rest := bucket[k + 1 :]:
                        open_bucket(rank, rest)
                    break
        starts, at = [], 0
        while at < n:
            starts.append(at)
            at = after[at]
        ids = np.fromiter((ranks[data[i : after[i]]] for i in starts), np.int32, len(starts)).tobytes()
        edge = (4 * np.searchsorted(starts, bound)).tolist()
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id without a token is an error."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def vocabulary(ranks_path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a path and pattern, read once per Python worker."""
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (array of int); nothing is shuffled.

    Null texts are empty and have no ids. Repeated rows and null ids stay, extra
    columns are ignored, an empty table gives no rows. Texts and pre-tokens are encoded
    whole, however long; special strings are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path, pattern)
        for batch in batches:
            found = words.encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return map_batches(spread(with_text(docs, "doc_id")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Rows of ``encoded`` (doc_id, ids), with ``bytes``: what the ids stand for.

    Null or empty ids are empty bytes; a null id inside, or one without a token, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            ids = batch.column(1)
            if ids.values.null_count:
                raise ValueError("a null among the ids of a text")
            values, edge = ids.values.to_numpy(), ids.offsets.to_numpy()
            found = [words.decode(values[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(found, pa.binary())], names=["doc_id", "ids", "bytes"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, bytes binary")
