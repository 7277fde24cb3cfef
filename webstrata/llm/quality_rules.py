"""Quality rules: a base check of counts, then repetition coverage.

Coverage: for several n-gram lengths, the share of a text's word characters that
lie inside word n-grams seen before in the same text; and the share of characters
in lines seen before. Hashes roll over a whole Arrow batch in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webstrata.llm import wordhash as W
from webstrata.llm.common import map_batches, utf8, with_text
from webstrata.sources.tables import spread

#: n of the word n-grams, and the share of characters in repeated ones beyond which a text is rejected; the same for
#: lines: the limits published with the MassiveText corpus (Rae et al. 2021, appendix A).
NGRAMS = {5: 0.15, 8: 0.12, 10: 0.10}
LINES = 0.20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WHITE = b" \t\n\x0b\x0c\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in NGRAMS)
)


def repeated(grams: np.ndarray, valid: np.ndarray, first: bool) -> np.ndarray:
    """Of each valid n-gram, whether it is found twice or more (``first``), or was found before."""
    out, place = np.zeros(len(grams), bool), np.flatnonzero(valid)
    if len(place) < 2:
        return out
    order = place[np.argsort(grams[place], kind="stable")]
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[1:]] = same
    if first:
        out[order[:-1]] |= same
    return out


def covered(hit: np.ndarray, words: int, n: int) -> np.ndarray:
    """Of each word, whether one of the marked n-grams covers it."""
    edge = np.zeros(words + n + 1, np.int32)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:words]) > 0


def lines_of(text: bytes) -> tuple[int, int, int]:
    """Of the lines with a word: how many are equal to an earlier one, the characters in these, and in all."""
    seen, again, again_chars, chars = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            size = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
            chars += size
            if line in seen:
                again, again_chars = again + 1, again_chars + size
            seen.add(line)
    return again, again_chars, chars


def measure_batch(texts: list[bytes]) -> list[np.ndarray]:
    """All columns of SCHEMA but doc_id. Words are hashed, and repeats found, over the whole batch at once: an n-gram's hash has its text's number in it."""
    data = b"\n".join(texts)
    hashes, start, end = W.words(data, fold=False)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    chars = (points[end] - points[start]).astype(np.int64)
    edge = np.cumsum([0, *(len(x) + 1 for x in texts)])
    bound = np.searchsorted(start, edge)
    n_words, owner = np.diff(bound), np.repeat(np.arange(len(texts)), np.diff(bound))
    salt = W.mix(np.arange(1, len(texts) + 1, dtype=np.uint64) * W.STEP)[owner]
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[np.frombuffer(data, np.uint8)])))
    ends = np.minimum(edge[1:] - 1, len(data))

    def per_text(of_words: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of_words, dtype=np.int64)))
        return total[bound[1:]] - total[bound[:-1]]

    def repeats(n: int, first: bool) -> np.ndarray:
        grams = W.windows(hashes, n)
        if not len(grams):
            return np.zeros(len(hashes), bool)
        inside = owner[: len(grams)] == owner[n - 1 :]
        return covered(repeated(grams ^ salt[: len(grams)], inside, first), len(hashes), n)

    word_chars = per_text(chars)
    n_repeat = per_text(repeats(3, True))
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    again, again_chars, line_chars = np.array([lines_of(t) for t in texts], np.int64).reshape(-1, 3).T
    line_share = again_chars / np.maximum(line_chars, 1)
    shares = [per_text(np.where(repeats(n, False), chars, 0)) / np.maximum(word_chars, 1) for n in NGRAMS]
    kept = ~base_failed & (line_share <= LINES)
    for share, most in zip(shares, NGRAMS.values(), strict=True):
        kept &= share <= most
    return [n_words, word_chars, symbols[ends] - symbols[edge[:-1]], again, n_repeat, base_failed, kept, line_share, *shares]


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), see SCHEMA; nothing is shuffled.

    Null and empty texts have no words and fail the base check. Repeated rows are
    measured alike, a null doc_id stays null, extra columns are ignored, an empty
    table gives no rows. A text is measured whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, parts = batch.column(0), utf8(batch.column(1)), []
            for at in range(0, len(texts), 64):
                parts.append(measure_batch(texts[at : at + 64]))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(NGRAMS))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_batches(spread(with_text(docs, "doc_id")), run, SCHEMA)
