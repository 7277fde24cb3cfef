"""Phrase collocation mining with mergeable Misra-Gries summaries.

Words are counted exactly; phrases in two passes. The first sends hashes of n-grams
to hash partitions, each of which keeps one Misra-Gries summary a length. A summary's
capacity exceeds its partition's mass (n-gram occurrences) divided by the threshold,
so that what it has lost of a count stays below the threshold and every frequent
n-gram survives. The second pass counts the survivors exactly, by their words.

A frequent phrase has frequent parts. So only n-grams of frequent words are sent for
pairs, and for longer phrases only those whose pairs all survived. Which words, pairs
and phrases these are, tasks learn from bitmaps of a fixed number of bits: a hash may
hit a bit that is not its own, which costs a row, but never loses one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import wordhash as W
from webstrata.llm.common import map_batches, materialize, utf8
from webstrata.operators.order import first_of_each
from webstrata.sources.tables import spread

LONGEST, THRESHOLD, TOP = 5, 100, 2000
#: Bits of a bitmap, as a power of two: 8 MiB for each that is sent to the tasks. More bits spare rows where there are many frequent phrases; results are the same.
FILTER_BITS = 26
#: A-Z lower-cased; what ends a piece as a line feed, a tab as a space.
BYTES = bytes(x + 32 if 65 <= x <= 90 else 10 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x for x in range(256))
#: Rows that a task gathers before it passes them on.
HELD_WORDS, HELD_KEYS = 1 << 18, 1 << 20
COUNTED = "lang string, phrase string, n int, part int, count long"
KEYS = "n int, part int, key long, count long"


class Words:
    """The words of some texts as hashes: which language each has, and which follow each other in a piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join(texts).translate(BYTES)
        self.data = re.sub(b"  +", b" ", data) if b"  " in data else data
        word, self.start, self.end = W.words(self.data, fold=False)
        line = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
        ends = np.cumsum([len(t) + 1 for t in texts]) if self.data is data else np.cumsum([len(re.sub(b"  +", b" ", t.translate(BYTES))) + 1 for t in texts])
        self.owner = np.searchsorted(ends, self.start, side="right")
        self.piece = np.searchsorted(line, self.start)
        names = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")) for x in set(langs)}
        self.lang = np.array([names[x] for x in langs], np.uint64)[self.owner]
        self.word = W.mix(word ^ self.lang)

    def follow(self, n: int) -> np.ndarray:
        """Of each word, whether it and the next n - 1 are in one piece."""
        return self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :] if len(self.piece) >= n else np.empty(0, bool)

    def keys(self, n: int) -> np.ndarray:
        """A hash of each n words in a row with their language."""
        return W.mix(W.windows(self.word, n) + np.uint64(n))

    def chosen(self, n: int, words: Bitmap, pairs: Bitmap | None) -> np.ndarray:
        """Where phrases of n words start whose words are in ``words`` and whose pairs are in ``pairs``."""
        ok = self.follow(n)
        if not len(ok):
            return np.empty(0, np.int64)
        single = words.has(self.word)
        for k in range(n):
            ok = ok & single[k : len(single) - n + 1 + k]
        if pairs is not None and n > 1:
            two = pairs.has(self.keys(2))
            for k in range(n - 1):
                ok = ok & two[k : len(two) - n + 2 + k]
        return np.flatnonzero(ok)


class Bitmap:
    """A set of 64-bit hashes in 2^bits bits: all that were put in are found, and a few others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & np.uint64((1 << self.bits) - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame, bits: int) -> Bitmap:
    """The bitmap of a column ``key``, put together by Spark: the driver gets 2^(bits - 6) words at most."""
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("value")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return Bitmap(bits, words)


class MisraGries:
    """Counts of at most ``capacity`` keys. A key's count is too low by ``lost`` at most, which stays below mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.key, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.more.append((key, count))
        self.waiting += len(key)
        if self.waiting >= max(self.capacity, 1 << 16):
            self.fold()

    def merge(self, other: MisraGries) -> None:
        """Takes in the summary of other rows."""
        other.fold()
        self.lost += other.lost
        self.add(other.key, other.count)
        self.fold()

    def fold(self) -> None:
        """Adds what waits; if keys are too many, takes from all counts what the first key beyond the capacity has."""
        key, at = np.unique(np.concatenate([self.key, *(k for k, _ in self.more)]), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, at, np.concatenate([self.count, *(c for _, c in self.more)]))
        self.more, self.waiting = [], 0
        if len(key) > self.capacity:
            cut = np.partition(count, len(key) - self.capacity - 1)[len(key) - self.capacity - 1]
            self.lost += int(cut)
            key, count = key[count > cut], count[count > cut] - cut
        self.key, self.count = key, count

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key of the mass with ``threshold`` occurrences or more, and some with fewer."""
        self.fold()
        return self.key[self.count + self.lost >= threshold]


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    for batch in batches:
        yield utf8(batch.column(1)), batch.column(0).to_pylist()


def counted_rows(counts: dict[str, Counter], n_of=lambda phrase: phrase.count(b" ") + 1) -> pa.RecordBatch:
    langs, phrases, numbers = [], [], []
    for lang, own in counts.items():
        langs += [lang] * len(own)
        phrases += own.keys()
        numbers += own.values()
    n = pa.array([n_of(p) for p in phrases], pa.int32())
    columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), n, pa.nulls(len(n), pa.int32()), pa.array(numbers, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in COUNTED.split(", ")])


def words_and_mass(docs: DataFrame, parts: int) -> DataFrame:
    """Counts of words by language (n = 1), and the n-gram occurrences of each hash partition (no phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        mass = np.zeros((LONGEST + 1, parts), np.int64)
        for texts, langs in batches_of(batches):
            words = Words(texts, langs)
            for n in range(2, LONGEST + 1):
                keys = words.keys(n)[words.follow(n)]
                mass[n] += np.bincount((keys % np.uint64(parts)).astype(np.int64), minlength=parts)
            for text, lang in zip(texts, langs, strict=True):
                counts.setdefault(lang, Counter()).update(text.translate(BYTES).split())
            if sum(map(len, counts.values())) >= HELD_WORDS:
                yield counted_rows(counts, lambda _: 1)
                counts = {}
        yield counted_rows(counts, lambda _: 1)
        n, part = np.nonzero(mass)
        none = pa.nulls(len(n), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(n, pa.int32()), pa.array(part, pa.int32()), pa.array(mass[n, part])], names=[x.split()[0] for x in COUNTED.split(", ")])

    return map_batches(docs, run, COUNTED).groupBy("lang", "phrase", "n", "part").agg(F.sum("count").alias("count"))


def word_keys(words: DataFrame) -> DataFrame:
    """The hashes of rows (lang, phrase) of one word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Words(utf8(batch.column(1)), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.word.view(np.int64))], names=["key"])

    return map_batches(words.select("lang", "phrase"), run, "key long")


def survivors(docs: DataFrame, lengths: range, words, pairs, mass: dict[tuple[int, int], int], parts: int, threshold: int) -> DataFrame:
    """First pass: (n, key) of n-grams that may have ``threshold`` occurrences, from one summary a length and hash partition."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {n: [] for n in lengths}

        def rows() -> Iterator[pa.RecordBatch]:
            for n, keys in held.items():
                key, count = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]), return_counts=True)
                part = (key % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), pa.array(part), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["n", "part", "key", "count"])
                keys.clear()

        for texts, langs in batches_of(batches):
            found = Words(texts, langs)
            for n in lengths:
                held[n].append(found.keys(n)[found.chosen(n, words.value, pairs.value if pairs else None)])
            if sum(len(k) for keys in held.values() for k in keys) >= HELD_KEYS:
                yield from rows()
        yield from rows()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], MisraGries] = {}
        for batch in batches:
            n, part, key, count = (c.to_numpy() for c in batch.columns)
            group = part.astype(np.int64) * (LONGEST + 1) + n
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                at = int(n[own[0]]), int(part[own[0]])
                if at not in kept:
                    kept[at] = MisraGries(mass[at] // threshold + 1)
                kept[at].add(key[own], count[own])
        for (n, _), summary in kept.items():
            key = summary.survivors(threshold)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), pa.array(key)], names=["n", "key"])

    return map_batches(docs, send, KEYS).repartition(parts, "part").mapInArrow(summarise, "n int, key long")


def exact_counts(docs: DataFrame, words, pairs, longer) -> DataFrame:
    """Second pass: the occurrences of phrases whose hashes survived, counted by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for texts, langs in batches_of(batches):
            found = Words(texts, langs)
            data, start, end, owner = found.data, found.start, found.end, found.owner
            for n in range(2, LONGEST + 1):
                at = found.chosen(n, words.value, pairs.value)
                if n > 2:
                    at = at[longer.value.has(found.keys(n)[at])]
                for k in np.split(at, np.flatnonzero(np.diff(owner[at])) + 1) if len(at) else []:
                    phrases = [data[a:b] for a, b in zip(start[k].tolist(), end[k + n - 1].tolist(), strict=True)]
                    counts.setdefault(langs[owner[k[0]]], Counter()).update(phrases)
            if sum(map(len, counts.values())) >= HELD_WORDS:
                yield counted_rows(counts)
                counts = {}
        yield counted_rows(counts)

    return map_batches(docs, run, COUNTED).groupBy("lang", "phrase", "n").agg(F.sum("count").alias("a"))


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, bits: int = FILTER_BITS, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to five words with ``threshold`` occurrences in a language: lang, phrase, n (its words), a; and lang, total (all its words)."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    counted = materialize(words_and_mass(own, parts), "words")
    words = counted.where("phrase is not null").select("lang", "phrase", "n", F.col("count").alias("a"))
    mass = {(r["n"], r["part"]): r["count"] for r in counted.where("phrase is null").collect()}  # four rows a hash partition
    totals, words = words.groupBy("lang").agg(F.sum("a").alias("total")), words.where(F.col("a") >= threshold)
    send = spark.sparkContext.broadcast
    of_words = send(bitmap(word_keys(words), bits))
    of_pairs = send(bitmap(materialize(survivors(own, range(2, 3), of_words, None, mass, parts, threshold), "pairs"), bits))
    of_longer = send(bitmap(materialize(survivors(own, range(3, LONGEST + 1), of_words, of_pairs, mass, parts, threshold), "longer"), bits))
    phrases = materialize(exact_counts(own, of_words, of_pairs, of_longer).where(F.col("a") >= threshold), "phrases")
    return words.unionByName(phrases), totals


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, bits: int = FILTER_BITS, parts: int | None = None) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang (null: ``und``) and text (null: empty). A phrase of two to five
    words within a piece counts with all its occurrences, overlaps included; repeated
    rows count each. Its score is the least over its cuts in two, the shortest first
    part where scores are equal; phrases inside a longer one that is as frequent go.
    Ties in score are ranked by count, then by phrase. Extra columns are ignored, an
    empty table gives no rows. Texts count whole, however long.
    """
    found, totals = frequent_phrases(docs, threshold, bits, parts)
    words = F.split("phrase", " ")
    several = found.where("n > 1").withColumn("w", words)
    joined = lambda start, size: F.expr(f"array_join(slice(w, {start}, {size}), ' ')")
    cut = several.join(totals, "lang").select("lang", "phrase", "a", "total", "n", "w", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "total", "k", joined("1", "k").alias("first"), joined("k + 1", "n - k").alias("rest"))
    left = found.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000 * {big('a')} * {big('total')}) div ({big('l')} * {big('r')})")
    least = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spans = F.explode(F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), s -> array_join(slice(w, s, m), ' '))))"))
    inside = several.where("n > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = least.join(inside, ["lang", "phrase"], "left").where("within is null or within < a")
    placed = kept.select("lang", "phrase", "a", "total", "cut", (-F.col("cut.score")).alias("down"), (-F.col("a")).alias("fewer"))
    ranked = first_of_each(placed, ["lang"], ["down", "fewer", "phrase"], F.lit(top))  # a language is in many ranges
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
