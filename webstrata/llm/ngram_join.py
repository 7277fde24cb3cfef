"""Self-join of texts by the Jaccard similarity of their word 5-gram sets.

Sets are compared by token-combination prefixes. A token is a shingle's 64-bit hash;
all sets are sorted in one order, rare tokens (by hash) before frequent ones (by hash).
With o the least overlap of a set with anything that it links with, two linked sets
share a token in their first size - o + 1.

* Where these are all rare, each is indexed on its own.
* Else all rare tokens of the set lie in it and are indexed on their own, and the prefix
  is extended over all frequent ones, which are indexed in combinations of k neighbours.
  Two sets that share no rare token differ in at most a quarter of their union, so
  their shared tokens fall into few runs, one of which has k = 3 (k = 2, where the
  union has 8 tokens or less) neighbours that are neighbours in both.

So no link is lost. What shares an index entry is a candidate pair; sizes and parity
sketches rule out most that don't link, the others are verified on the texts. Buckets of
more than a few sets are first linked to one of their sets; only where this leaves
several components in a bucket, their sets are compared across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from webstrata.llm import wordhash as W
from webstrata.llm.common import free_name, map_batches, materialize, utf8, with_text
from webstrata.llm.components import components
from webstrata.sources.tables import spread

#: A link: 100 * intersection >= 75 * union.
PERCENT = 75
WORDS = 5
#: At most so many frequent tokens are kept (8 bytes each, sent to all tasks), those of the most documents.
MOST_FREQUENT = 1 << 20
#: Tokens known to be in fewer sets are rare.
LEAST_FREQUENT = 8
#: Tokens counted together before those seen once are left out.
COUNTED = 2_000_000
#: Sets that a task remembers, so as not to index their copies.
REMEMBERED = 1 << 18
#: Up to so many sets in a bucket, all pairs are candidates.
FEW = 4
#: Sets of an open bucket that one task compares with each other; larger buckets are dealt into blocks.
BLOCK = 2048
#: Before all pairs of an open bucket are tried: buckets that a set is looked up in, and its nearest sets there.
PROBES, NEAREST = 8, 2
#: Bits of a set's sketch: each bit is the parity of the set's tokens that fall on it.
BITS = 1024
#: Pairs verified against one set in one group of rows.
SIDE = 100
#: Pairs whose places (some 60 bytes each) are sent to all tasks; beyond, they are joined by shuffle.
SMALL = 100_000
DOC, TOKEN = 0, 1
K1, K2, K3 = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def set_id(tokens: np.ndarray) -> int:
    """One number for a set: two sums over its tokens, mixed with its size."""
    with np.errstate(over="ignore"):
        total = W.mix(np.array([W.mix(tokens ^ K1).sum(dtype=np.uint64) + np.uint64(len(tokens)) * K2]))
    return int(total.view(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes:
    """BITS parities. Two sketches differ in at most as many bits as their sets in tokens."""
    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Which pairs sizes and sketches (rows of 64-bit words) don't rule out. What is ruled out can't link."""
    total = n_a + n_b
    least = -(-PERCENT * total // (100 + PERCENT))  # of the overlap
    fits = least <= np.minimum(n_a, n_b)
    fits[fits] = np.bitwise_count(bits_a[fits] ^ bits_b[fits]).sum(1, dtype=np.int64) <= (total - 2 * least)[fits]
    return fits


def words_of(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def sets_and_counts(docs: DataFrame) -> DataFrame:
    """(kind, a, b, n, bits): for each document DOC, doc_id, set_id, set size, sketch; for tokens seen repeatedly TOKEN, token, 0, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def emit(kind: int, a: pa.Array, b, n, bits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), a, pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["kind", "a", "b", "n", "bits"]
            )

        def tokens() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            often = times >= 2
            return emit(TOKEN, pa.array(found[often].view(np.int64)), np.zeros(int(often.sum()), np.int64), times[often], [None] * int(often.sum()))

        for batch in batches:
            texts, ids, sizes, bits = utf8(batch.column(1)), [], [], []
            for at in range(0, len(texts), 64):
                for s in W.shingle_sets(texts[at : at + 64], WORDS):
                    ids.append(set_id(s) if len(s) else None)
                    sizes.append(len(s))
                    bits.append(sketch(s) if len(s) else None)
                    waiting.append(s)
                    held += len(s)
            yield emit(DOC, batch.column(0).cast(pa.int64()), ids, sizes, bits)
            if held >= COUNTED:
                yield tokens()
                waiting, held = [], 0
        if waiting:
            yield tokens()

    return map_batches(spread(with_text(docs, "doc_id")), run, "kind int, a long, b long, n long, bits binary")


def frequent_tokens(counts: DataFrame) -> np.ndarray:
    """The sorted tokens of the most sets: as many as the bound allows, by a least count that follows the data.

    A token's count is over the stretches of COUNTED tokens in which it is repeated, so
    it is a lower bound; any choice of frequent tokens gives the same links.
    """
    seen = materialize(counts.where(F.col("kind") == TOKEN).groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT), "tokens")
    level = F.floor(F.log2("n") * 4).cast("int")
    levels = {r["level"]: r["n"] for r in seen.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for k in sorted(levels, reverse=True):
        if (total := total + levels[k]) > MOST_FREQUENT:
            break
        least = k
    if least is None:
        return np.empty(0, np.int64)
    return np.sort(seen.where(level >= least).select("token").toArrow()["token"].to_numpy())


class Frequent:
    """Which tokens are frequent: a table of bits first, then a search."""

    BITS = 22

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens.view(np.uint64)
        self.tokens.sort()
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.tokens >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = self.maybe[(s >> np.uint64(64 - self.BITS)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.searchsorted(self.tokens, s[at])
            out[at] = self.tokens[np.minimum(place, len(self.tokens) - 1)] == s[at]
        return out


def signatures(s: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The index entries of a set (sorted tokens)."""
    often = frequent(s)
    rare, n = s[~often], len(s)
    prefix = n - (PERCENT * n + 99) // 100 + 1
    if len(rare) >= prefix:
        return rare[:prefix]
    f = s[often]
    out = [rare]
    if len(f) >= 3:
        out.append(W.mix(f[:-2] * K1 + f[1:-1] * K2 + f[2:] * K3))
    if n <= 8 and len(f) >= 2:
        out.append(W.mix(f[:-1] * K2 + f[1:] * K3 + K1))
    return np.concatenate(out)


def index(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, set_id) of every text with words; copies that a task reads are indexed once, as far as it remembers them."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Frequent(np.array(shared.value)), set()
        for batch in batches:
            texts = utf8(batch.column(0))
            for at in range(0, len(texts), 64):
                if len(seen) > REMEMBERED:
                    seen.clear()
                sets = {set_id(s): s for s in W.shingle_sets(texts[at : at + 64], WORDS) if len(s)}
                sets = {i: s for i, s in sets.items() if i not in seen}
                seen.update(sets)
                sigs = [signatures(s, known) for s in sets.values()]
                if sigs:
                    ids = np.repeat(np.array(list(sets), np.int64), [len(x) for x in sigs])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(ids)], names=["sig", "set_id"])

    return map_batches(spread(with_text(docs)), run, "sig long, set_id long")


PAIR, MEMBER = 0, 1
#: Distinct sets of one bucket that are held at once; a larger bucket is cut.
CUT = 50_000


def candidates(entries: DataFrame, most: int = CUT) -> DataFrame:
    """(kind, a, b): PAIR, set, set with a < b; MEMBER, sig, set, for the buckets that need a second look.

    Entries are dealt by signature and sorted; buckets are runs of equal signatures, read
    as a stream, so that a bucket may be of any size. Copies are left out as they are read;
    all sets of a bucket of more than ``most`` that had to be cut are MEMBERs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_sig, rest_id = np.empty(0, np.int64), np.empty(0, np.int64)
        pairs: list[np.ndarray] = []
        held = 0
        head: tuple[int, int, int] | None = None  # of a bucket that was cut: signature, first set, and last set that was written

        def out(kind: int, ab: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ab), kind, np.int32)), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["kind", "a", "b"])

        def distinct(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            return sig[new], ids[new]

        def work(sig: np.ndarray, ids: np.ndarray, was_cut: int | None, goes_on: bool) -> Iterator[np.ndarray]:
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
            size = np.diff(np.append(start, len(sig)))
            owner = np.repeat(np.arange(len(start)), size)
            rank = np.arange(len(sig)) - start[owner]
            first = ids[start[owner]]
            star = rank > 0
            yield np.stack([first[star], ids[star]], 1)
            for k in range(1, FEW - 1):  # all pairs of small buckets: with the k-th set, too
                deep = (rank > k) & (size[owner] <= FEW)
                yield np.stack([ids[start[owner[deep]] + k], ids[deep]], 1)
            large = size[owner] > FEW
            if was_cut is not None:  # the sets of the other parts are not here, so that few sets in this one say nothing
                large |= sig == was_cut
            if goes_on:  # the first set has been written with the first part
                large[:1] = False
            yield np.stack([sig[large], ids[large]], 1)

        for batch in batches:
            sig = np.concatenate([rest_sig, batch.column(0).to_numpy()])
            ids = np.concatenate([rest_id, batch.column(1).to_numpy()])
            if not len(sig):
                continue
            sig, ids = distinct(sig, ids)
            goes_on = head is not None
            if goes_on:  # copies of the set that the part before ended with
                new = (sig != head[0]) | (ids != head[2]) | (np.arange(len(sig)) == 0)
                sig, ids = sig[new], ids[new]
            # the last bucket may go on; one that is too large is cut, each part with the first set in front
            cut, last = int(np.searchsorted(sig, sig[-1])), head
            if cut == 0 and len(sig) > most:
                cut, last = len(sig), (int(sig[-1]), int(ids[0]), int(ids[-1]))
            done_sig, done_id, rest_sig, rest_id = sig[:cut], ids[:cut], sig[cut:], ids[cut:]
            if cut == len(sig):
                rest_sig, rest_id = np.array([last[0]]), np.array([last[1]])
            *some, members = work(done_sig, done_id, last and last[0], goes_on)
            head = last if len(rest_sig) and last and rest_sig[0] == last[0] else None
            pairs += [p for p in some if len(p)]
            held += sum(map(len, some))
            if len(members):
                yield out(MEMBER, members)
            if held > 500_000:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
                held = len(pairs[0])
                if held > 250_000:
                    yield out(PAIR, pairs[0])
                    pairs, held = [], 0
        *some, members = work(rest_sig, rest_id, head and head[0], head is not None)
        pairs += [p for p in some if len(p)]
        if len(members):
            yield out(MEMBER, members)
        if pairs:
            yield out(PAIR, np.unique(np.concatenate(pairs), axis=0))

    dealt = entries.repartition("sig").sortWithinPartitions("sig", "set_id")
    return dealt.mapInArrow(run, "kind int, a long, b long")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, doc_a, doc_b) of the pairs of set ids that sizes and sketches don't rule out.

    ``sets``: set_id, doc_id, n, bits, one row a set.
    """
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "doc_a", "doc_b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_link(batch.column(4).to_numpy(), batch.column(5).to_numpy(), words_of(batch.column(6)), words_of(batch.column(7)))
            yield batch.select(["a", "b", "doc_a", "doc_b"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a long, b long, doc_a long, doc_b long")


def verify(near: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b, doc_a, doc_b; a written table) whose texts link.

    For each pair the text of b goes to where the text of a is; where a has many
    partners, to one of several such places.
    """
    many = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("sides"), F.first("doc_a").alias("doc_a"))
    heads = many.select(F.col("doc_a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.col("a").alias("own"), F.lit(0).alias("role"))
    placed = near.join(many.select("a", "sides"), "a").withColumn("side", F.pmod(F.xxhash64("b"), F.col("sides")).cast("int"))
    tails = placed.select(F.col("doc_b").alias("doc_id"), "a", "side", F.col("b").alias("own"), F.lit(1).alias("role"))
    texts = with_text(docs.where("doc_id is not null"), "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    places = heads.unionByName(tails)
    # few places go to the texts; else the texts are dealt by id
    rows = texts.join(F.broadcast(places) if near.count() <= SMALL else places, "doc_id").select("a", "side", "role", "own", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, np.empty(0, np.uint64)
        for batch in batches:
            a, side, role, own = (batch.column(i).to_numpy() for i in range(4))
            texts, found = utf8(batch.column(4)), []
            for at in range(0, len(texts), 64):
                for i, s in enumerate(W.shingle_sets(texts[at : at + 64], WORDS), at):
                    if not len(s) or set_id(s) != own[i]:  # another row of the same doc_id
                        continue
                    if role[i] == 0:
                        key, head = (a[i], side[i]), s
                    elif key == (a[i], side[i]):
                        both = len(np.intersect1d(head, s, assume_unique=True))
                        if 100 * both >= PERCENT * (len(head) + len(s) - both):
                            found.append((a[i], own[i]))
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("a", "side").sortWithinPartitions("a", "side", "role")
    return map_batches(dealt, run, "a long, b long").distinct()


def across(members: DataFrame, nearest: int | None) -> DataFrame:
    """(a, b), a < b: pairs of sets in one bucket but in different components that may link.

    ``nearest``: only so many pairs of each set, those whose sketches differ least; None: all.

    ``members``: sig, blocks, set_id, component, n, bits. A bucket is compared in numpy,
    all but its largest component with everything; a large one is dealt into blocks of
    about BLOCK sets, each pair of blocks a group of its own.
    """
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "component", "set_id", "n", "bits")

    def pairs(component: np.ndarray, ids: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        kinds, kind, times = np.unique(component, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return
        few = np.flatnonzero(kind != times.argmax())
        place = np.full(len(ids), len(ids), np.int64)
        place[few] = np.arange(len(few))  # of two such sets, the pair is looked at once
        for at in range(0, len(few), 32):
            row = few[at : at + 32]
            fits = (kind[row][:, None] != kind) & (100 * np.minimum(n[row][:, None], n) >= PERCENT * np.maximum(n[row][:, None], n)) & (place[row][:, None] < place)
            i, j = np.nonzero(fits)
            i = row[i]
            ok = may_link(n[i], n[j], bits[i], bits[j])
            i, j = i[ok], j[ok]
            if nearest is not None and len(i):
                order = np.lexsort((ids[j], np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64), i))
                i, j = i[order], j[order]
                begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                first = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < nearest
                i, j = i[first], j[first]
            i, j = ids[i], ids[j]
            yield np.stack([np.minimum(i, j), np.maximum(i, j)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        found: list[np.ndarray] = []

        def work(table: pa.Table) -> None:
            table = table.combine_chunks()
            sig, x, y, component, ids, n = (table[c].to_numpy() for c in ("sig", "x", "y", "component", "set_id", "n"))
            bits = words_of(table["bits"])
            edge = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True])))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                found.extend(pairs(component[a:b], ids[a:b], n[a:b], bits[a:b]))

        def out() -> pa.RecordBatch:
            ab = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy(), pa.int64()), pa.array(ab[:, 1].copy(), pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = [table[c][-1].as_py() for c in ("sig", "x", "y")] if len(table) else None
            if last is None:
                continue
            sig, x, y = (table[c].to_numpy() for c in ("sig", "x", "y"))
            cut = int(np.argmax((sig == last[0]) & (x == last[1]) & (y == last[2])))  # the last group may go on
            if cut:
                work(table.slice(0, cut))
            rest = table.slice(cut)
            if sum(map(len, found)) > 200_000:
                yield out()
        if rest is not None and len(rest):
            work(rest)
        yield out()

    dealt = cells.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, counts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): verified links between set ids, enough of them to connect all that is connected."""
    found = materialize(candidates(index(docs, frequent_tokens(counts))), "candidates")
    near = materialize(plausible(found.where(F.col("kind") == PAIR).select("a", "b").distinct(), sets), "near")
    linked = materialize(verify(near, docs), "linked")
    bucket = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("sig"), F.col("b").alias("set_id"))
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # first what is nearest, so that a group of copies becomes one component by few pairs; then all that is left
    for nearest in (NEAREST, None):
        cluster = components(linked)
        members = bucket.join(cluster.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        members = materialize(members, "members")
        blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
        mixed = members.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"), blocks)
        open_ = members.join(mixed.where("least < most").select("sig", "blocks"), "sig")
        if nearest is not None:
            place = Window.partitionBy("set_id").orderBy("sig")
            open_ = open_.withColumn("place", F.row_number().over(place)).where(F.col("place") <= PROBES).drop("place")
        open_ = open_.join(sets.select("set_id", "n", "bits"), "set_id")
        more = materialize(plausible(across(open_, nearest).join(tried, ["a", "b"], "left_anti"), sets), "more")
        tried = tried.unionByName(more.select("a", "b"))
        linked = materialize(linked.unionByName(verify(more, docs)), "linked")
    return linked


def documents_and_sets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, set_id, n_shingles, component_id; see join_documents."""
    counts = materialize(sets_and_counts(docs), "sets")
    rows = counts.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("set_id"), "n", "bits")
    sets = materialize(rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "distinct")
    cluster = components(links(docs, counts, sets))
    named = sets.join(cluster.withColumnRenamed("node", "set_id"), "set_id").select("set_id", "component", "doc_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    home = sets.join(named.join(least, "component").select("set_id", "least"), "set_id", "left").select("set_id", F.coalesce("least", "doc_id").alias("component_id"))
    known = F.col("doc_id").isNotNull()
    out = rows.join(home, "set_id", "left")
    return out.select("doc_id", "set_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def join_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id: the smallest doc_id reachable by links, itself included. Null and
    empty texts have no shingles and are alone, as are rows with a null doc_id (whose
    component_id is null). Equal sets are one set from the start, so copies cost no
    comparison; rows that repeat a doc_id link by their own texts. Very long texts
    are hashed in stretches; extra columns are ignored; an empty table gives no rows.
    """
    return documents_and_sets(docs).drop("set_id")


def with_set_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with one more column, the id of the text's set (null for a text without words)."""
    names, place = [*docs.columns, name], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(place))
            ids = [set_id(s) if len(s) else None for at in range(0, len(texts), 64) for s in W.shingle_sets(texts[at : at + 64], WORDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=names)

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, all columns as they were; rows without an id stay.

    Where rows that repeat an id share its fate, they are told by it; else by id and set, so
    that a row never goes because of another row's text. Texts are shuffled only if more
    than SMALL ids go.
    """
    goes = F.col("doc_id") != F.col("component_id")
    told = materialize(documents_and_sets(docs).where("doc_id is not null").groupBy("doc_id", "set_id").agg(F.max(goes).alias("goes")), "told")
    ids = told.groupBy("doc_id").agg(F.max("goes").alias("some"), F.min("goes").alias("all"))
    ids = materialize(ids.where("some").select(F.col("doc_id").alias("gone_id"), "all"), "gone")

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SMALL else df

    own = docs["doc_id"].cast("long") == F.col("gone_id")
    out = docs.join(near(ids), own, "left_anti")
    parted = ids.where("not all").select("gone_id")
    if parted.limit(1).count():
        name = free_name(docs, "set_id")
        some = with_set_id(docs.join(near(parted), own, "left_semi"), name)
        gone = told.where("goes").select(F.col("doc_id").alias("gone_id"), F.col("set_id").alias("gone_set"))
        same = (some["doc_id"].cast("long") == F.col("gone_id")) & (some[name] == F.col("gone_set"))
        out = out.unionByName(some.join(gone.join(parted, "gone_id", "left_semi"), same, "left_anti").drop(name))
    return out
