"""Ranked lexical search of many queries: term at a time over short lists, document at a time over long ones.

Documents become inverted segments of a bounded number of documents, which hold only
terms that are asked for. Statistics are summed up over all segments. Each task then
searches its segments for every item. Within a segment, the item's short lists are
added up term by term; the sums are one more list, with a bound of its own. That list
and the long ones are gone through in the order of documents: a range of documents
whose bounds cannot reach the item's k-th best score is skipped in all lists at once;
in the others the lists that cannot make a result on their own (by ascending bounds,
up to the k-th best score) are only looked up for documents that the rest has found.
The k best of an item are carried from one segment of a task to the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.llm.common import ascii_lower, map_batches, materialize, utf8, with_text
from webstrata.sources.tables import spread

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms with A-Z lower-cased, all others as spaces.
BYTES = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
#: A segment is closed at so many documents, or occurrences of terms that are asked for.
SEGMENT_DOCS, SEGMENT_TERMS = 1 << 14, 1 << 22
#: Documents whose bounds are taken together; a list is short if it has less than one in SHORT of a segment's documents.
RANGE, SHORT = 512, 32
#: (item, term) pairs that are sent to the tasks at once, about; items beyond go in further blocks.
BLOCK_PAIRS = 1 << 20
SEGMENT = "docs long, terms long, doc_id array<long>, n array<long>, term array<int>, df array<int>, doc array<int>, tf array<int>"


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)], dtype=np.int32)), pa.array(np.concatenate(values), kind))


class Builder:
    """Gathers documents until their segment is closed."""

    def __init__(self):
        self.docs = self.terms = self.held = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.found: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: int, found: np.ndarray) -> None:
        if words:
            self.docs, self.terms = self.docs + 1, self.terms + words
        if len(found):
            self.ids.append(doc_id)
            self.sizes.append(words)
            self.found.append(found)
            self.held += len(found)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.held >= SEGMENT_TERMS

    def close(self) -> pa.RecordBatch:
        """The segment as one row. Its documents are in the order of doc_id, null last, its postings in that of term and document."""
        null = np.array([x is None for x in self.ids], bool)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms = np.concatenate([np.empty(0, np.int32), *self.found]).astype(np.int64)
        docs = np.repeat(place, [len(x) for x in self.found])
        key, tf = np.unique(terms * max(len(order), 1) + docs, return_counts=True)
        term, df = np.unique(key // max(len(order), 1), return_counts=True)
        ids = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.array(ids[order], pa.int64(), mask=null[order]))
        sizes = np.array(self.sizes, np.int64)[order]
        row = [pa.array([self.docs]), pa.array([self.terms]), ids, lists([sizes], pa.int64())]
        row += [lists([x.astype(np.int32)], pa.int32()) for x in (term, df, key % max(len(order), 1), tf)]
        self.__init__()
        return pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in SEGMENT.split(", ")])


def index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Segments of ``docs`` (doc_id, text) over ``terms``; docs and terms count all documents with a term and all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, segment = shared.value.get, Builder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = text.translate(BYTES).split(b" ")
                found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                segment.add(doc_id, len(words) - words.count(b""), found[found >= 0])
                if segment.full():
                    yield segment.close()
        yield segment.close()

    return map_batches(spread(with_text(docs, "doc_id")), run, SEGMENT)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def lengths_of(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of each document: 100 - 75 + (75 * n * docs) div terms."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // terms for x in n], np.int64)
    return 25 + 75 * n * docs // terms


class Best:
    """The k best documents of an item so far: by score descending, then doc_id ascending, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.null, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        score, null, ids = np.concatenate((self.score, score)), np.concatenate((self.null, null)), np.concatenate((self.id, ids))
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.id = score[best], null[best], ids[best]
        if len(best) == self.k:
            self.least = max(1, int(self.score[-1]))


class Postings:
    """One list of an item within a segment: documents in order, their scores, and what is known of each range."""

    def __init__(self, doc: np.ndarray, score: np.ndarray, ranges: int):
        self.doc, self.score = doc, score
        self.cut = np.searchsorted(doc, np.arange(0, (ranges + 1) * RANGE, RANGE))  # where each range begins
        self.most = np.zeros(ranges, np.int64)
        some = np.flatnonzero(np.diff(self.cut))
        if len(some):
            self.most[some] = np.maximum.reduceat(score, self.cut[some])


class Segment:
    """A segment with the scores of its postings; ``search`` adds its documents to an item's best."""

    def __init__(self, row: dict, weights: np.ndarray, docs: int, terms: int):
        self.null, self.ids = row["null"], row["doc_id"]
        self.term, self.df = row["term"], row["df"].astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.df)))
        tf = row["tf"].astype(np.int64)
        self.doc = row["doc"]
        self.score = np.repeat(weights[self.term], self.df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths_of(row["n"], docs, terms)[self.doc]))
        self.ranges, self.long = -(-len(self.ids) // RANGE), {}

    def long_list(self, slot: int) -> Postings:
        """The list of a frequent term, shared by all items."""
        if slot not in self.long:
            own = slice(self.start[slot], self.start[slot + 1])
            self.long[slot] = Postings(self.doc[own], self.score[own], self.ranges)
        return self.long[slot]

    def summed(self, slots: np.ndarray, times: np.ndarray) -> Postings:
        """Term at a time: the scores of short lists, added up by document."""
        parts = [slice(self.start[s], self.start[s + 1]) for s in slots]
        doc = np.concatenate([self.doc[p] for p in parts])
        score = np.concatenate([self.score[p] * t for p, t in zip(parts, times, strict=True)])
        order = np.argsort(doc, kind="stable")
        doc, score = doc[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return Postings(doc[first], np.add.reduceat(score, first), self.ranges)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        slots = np.searchsorted(self.term, terms)
        there = slots < len(self.term)
        there[there] = self.term[slots[there]] == terms[there]
        slots, times = slots[there], times[there]
        if not len(slots):
            return
        short = self.df[slots] * SHORT < len(self.ids)
        all_lists = [(self.summed(slots[short], times[short]), 1)] if short.any() else []
        all_lists += [(self.long_list(s), t) for s, t in zip(slots[~short].tolist(), times[~short].tolist(), strict=True)]
        most = np.array([x.most * t for x, t in all_lists])
        reach = most.sum(axis=0)
        for r in np.flatnonzero(reach >= best.least).tolist():
            if reach[r] >= best.least:
                self.search_range(r, all_lists, most[:, r], best)

    def search_range(self, r: int, all_lists: list[tuple[Postings, int]], most: np.ndarray, best: Best) -> None:
        """Document at a time within one range: lists that can make a result find documents, the others are looked up."""
        order = np.argsort(most, kind="stable")
        upto = np.cumsum(most[order])
        few = int(np.searchsorted(upto, best.least))  # so many lists, all together, stay below the k-th best score
        score, found = np.zeros(RANGE, np.int64), np.zeros(RANGE, bool)
        for k in order[few:].tolist():
            postings, times = all_lists[k]
            own = slice(postings.cut[r], postings.cut[r + 1])
            at = postings.doc[own] - r * RANGE
            score[at] += postings.score[own] * times
            found[at] = True
        at = np.flatnonzero(found)
        score = score[at]
        for k in range(few - 1, -1, -1):
            can = score + upto[k] >= best.least
            at, score = at[can], score[can]
            if not len(at):
                return
            postings, times = all_lists[order[k]]
            own = slice(postings.cut[r], postings.cut[r + 1])
            doc = postings.doc[own]
            if len(doc):
                to = np.minimum(np.searchsorted(doc, at + r * RANGE), len(doc) - 1)
                score = score + np.where(doc[to] == at + r * RANGE, postings.score[own][to] * times, 0)
        can = score >= best.least
        if can.any():
            at = at[can] + r * RANGE
            best.add(score[can], self.null[at], self.ids[at])


def segments_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as arrays; null tells which doc_id is null."""
    for k in range(batch.num_rows):
        row = {name: batch.column(i)[k].values for i, name in enumerate(batch.schema.names)}
        out = {name: x.to_numpy(zero_copy_only=False) for name, x in row.items() if name != "doc_id"}
        ids = row["doc_id"]
        yield out | {"null": ids.is_null().to_numpy(zero_copy_only=False), "doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False)}


def blocks(pairs: DataFrame, most: int) -> Iterator[DataFrame]:
    """The items' terms in blocks of at most twice ``most`` rows, or one item."""
    n = pairs.count()
    parts = -(-n // most)
    while parts > 1:
        sizes = pairs.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("a"), F.max("item_id").alias("z"))
        if sizes.where((F.col("n") > 2 * most) & (F.col("a") < F.col("z"))).limit(1).count() == 0:
            break
        parts *= 2
    for k in range(parts):
        yield pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else pairs


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The k best rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Null texts are empty; an item without terms that any document has gives no rows.
    Rows of ``items`` with one item_id (null included) are one item with all their
    terms; rows of ``docs`` with one doc_id are documents of their own. Equal scores
    are ranked by doc_id, null last. Extra columns are ignored; an empty table on
    either side gives no rows. Texts count whole, however long. A block of items is
    sent to all tasks; documents are gone through once for each block.
    """
    spark, type_of = docs.sparkSession, dict(items.dtypes)["item_id"]
    terms = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    pairs = materialize(with_text(items, "item_id").select("item_id", terms.alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")
    found = spark.createDataFrame([], f"item_id {type_of}, doc_id long, score long")
    for block in blocks(pairs, block_pairs):
        found = found.unionByName(search_block(docs, block, k, type_of))
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_block(docs: DataFrame, pairs: DataFrame, k: int, type_of: str) -> DataFrame:
    """The k best of each task's segments for each item of a block."""
    spark = docs.sparkSession
    rows = pairs.collect()  # a block is bounded
    terms = sorted({r.term.encode() for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    items: dict = {}
    for r in rows:
        items.setdefault(r.item_id, []).append((number[r.term.encode()], r.times))
    segments = materialize(index(docs, terms), "segments")
    n, total, many = segments.agg(F.sum("docs"), F.sum("terms"), F.count(F.lit(1))).first()
    df = segments.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()  # a row a term of the block
    weights = np.zeros(len(terms), np.int64)
    for r in df:
        weights[r.term] = weight(n, r.df)
    asked = []
    for item, own in items.items():
        own = [x for x in sorted(own) if weights[x[0]] > 0]
        asked.append((item, np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)))
    shared = spark.sparkContext.broadcast((asked, weights, n, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, n, total = shared.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in segments_of(batch):
                segment = Segment(row, weights, n, total)
                for (_, own, times), b in zip(asked, best, strict=True):
                    segment.search(own, times, b)
        for (item, _, _), b in zip(asked, best, strict=True):
            if len(b.score):
                ids = pa.array(b.id, pa.int64(), mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), as_arrow(type_of)), ids, pa.array(b.score)], names=["item_id", "doc_id", "score"])

    tasks = max(spark.sparkContext.defaultParallelism, (many or 0) // 8)
    dealt = segments.drop("docs", "terms").repartition(tasks)
    return dealt.mapInArrow(run, f"item_id {type_of}, doc_id long, score long")


def as_arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]
