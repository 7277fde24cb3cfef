"""Packing documents into windows by non-negative least squares.

Documents are tokenised and cut into whole windows and a rest. The histogram of
rest lengths (at most one entry a length) is what the plan is made from: shallow
combinations of lengths that fill a window are enumerated, their repeat counts are
solved against the histogram by non-negative least squares and rounded down, and
what is left is packed greedily. Pieces then take their places by their rank among
pieces of the same length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.llm.common import map_batches, materialize, with_text
from webstrata.sources.tables import spread

WINDOW = 2048
END_ID = 1
#: Fixed value of the vocabulary: its one special string, which the ids' definition reads as one id inside texts, too.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict = {}


def encoder(ranks_path: str | None = None):
    """The byte-level BPE of ``ranks_path`` (lines: base64 of the bytes, rank); once per Python worker.

    The default has the same vocabulary and merges as byte_bpe_50k.json, in the
    layout of a library that is several times as fast; tests hold the two together.
    """
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def tokenise(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """The pieces of each row: whole windows, then the rest; ids_crc32 is over little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text, allowed_special="all"), END_ID], "<u4")
                rows += [(doc_id, a, len(x := ids[a : a + window]), zlib.crc32(x.tobytes()), len(ids)) for a in range(0, len(ids), window)]
            columns = zip(*rows, strict=True) if rows else ([] for _ in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return map_batches(spread(with_text(docs, "doc_id")), run, PIECES)


def combinations(lengths: np.ndarray, window: int, slack: int, most: int) -> list[tuple[int, ...]]:
    """Sets of two and three of the lengths that fill a window but for ``slack`` tokens.

    Pairs: each length with the longest that fits. Triples: the second part steps
    through the lengths, coarsely enough that there are at most ``most`` of both.
    """
    out, n = set(), len(lengths)
    fit = lambda gap: int(lengths[k - 1]) if (k := np.searchsorted(lengths, gap, side="right")) else 0
    for a in lengths.tolist():
        if (b := fit(window - a)) and a + b >= window - slack:
            out.add((max(a, b), min(a, b)))
    step = max(1, n * n // max(2 * most, 1))
    for i in range(n):
        for j in range(i % step, i + 1, step):
            a, b = int(lengths[i]), int(lengths[j])
            if a + b < window and (c := fit(min(b, window - a - b))) and a + b + c >= window - slack:
                out.add((a, b, c))
    return sorted(out)


def repeat_counts(combos: list[tuple[int, ...]], have: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Non-negative x that brings the combinations' lengths, x times each, closest to ``have`` (least squares).

    By coordinate descent: a column has three entries at most, so a step costs little.
    """
    x, rest = np.zeros(len(combos)), have.astype(float).copy()
    columns = [np.unique(c, return_counts=True) for c in combos]
    norms = [float((m * m).sum()) for _, m in columns]
    for _ in range(rounds):
        moved = 0.0
        for k, (at, times) in enumerate(columns):
            new = max(0.0, x[k] + float(rest[at] @ times) / norms[k])
            if (d := new - x[k]) != 0.0:
                rest[at] -= d * times
                x[k], moved = new, max(moved, abs(d))
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = 2, most: int = 6000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences); uses every piece of the histogram exactly once."""
    have = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        have[length] += n
    out = [((window,), int(have[window]))] if have[window] else []
    have[window] = 0
    combos = combinations(np.flatnonzero(have), window, slack, most)
    for combo, x in zip(combos, repeat_counts(combos, have), strict=True):
        at, times = np.unique(combo, return_counts=True)
        if (n := int(min(x, (have[at] // times).min()))) > 0:
            have[at] -= n * times
            out.append((combo, n))
    while len(lengths := np.flatnonzero(have)):  # greedily: the longest, then what fits into the gap; as often as the counts allow
        combo, gap, left = [], window, have.copy()
        while k := int(np.searchsorted(lengths, gap, side="right")):
            while k and not left[lengths[k - 1]]:
                k -= 1
            if not k:
                break
            combo.append(int(lengths[k - 1]))
            left[combo[-1]] -= 1
            gap -= combo[-1]
        at, times = np.unique(combo, return_counts=True)
        n = int((have[at] // times).min())
        have[at] -= n * times
        out.append((tuple(combo), n))
    return out


def places(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): from that rank on, one piece a sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for combo, n in steps:
        offset = 0
        for length in combo:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty: one id, the end mark. Repeated rows and null ids are packed
    like others, extra columns ignored; an empty table gives no rows. Only spans are
    shuffled, no tokens; the histogram (one count a length) is all that the driver
    gets, the plan (a few thousand combinations at most) all that the tasks get.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenise(docs, window, ranks_path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(histogram, window)))
    parts = max(1, sum(histogram.values()) // 4000)
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    sums = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                t = table[int(length[own[0]])]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = row[:, 1] + rank[own] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*(x.split()[0] for x in PIECES.split(", ")), "sequence_id", "offset"])

    columns = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return columns.mapInArrow(run, PIECES + ", sequence_id long, offset long")
