"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams, weighted by TF-IDF and scaled to length
one. Each language has several centroids (spherical k-means over a bounded sample
of labelled texts). The nearest centroid by cosine decides; a text much further from it
than other texts of the language and of that length is rejected. How far these are is
measured on a second sample, that the centroids are not made from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import map_batches, with_text
from webstrata.sources.tables import spread

DIMS = 1 << 12
NGRAMS = (1, 2, 3)
#: Bytes after lower-casing: all of ASCII but a-z becomes a space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[k for k in range(128) if not 97 <= k <= 122]] = 32
#: Lengths in characters at which distances are measured: short vectors are far from all centroids.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)
#: At a length where a language has fewer texts, the next shorter length's distances count.
LEAST_TEXTS = 8
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id is not held out, but not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    """float32 (texts, DIMS): hashed counts of byte n-grams of the lower-cased words; digits and symbols only part words."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        codes = PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))].astype(np.uint32)
        value = np.zeros_like(codes)
        for n in range(1, max(NGRAMS) + 1):
            value = value[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            mixed = value * np.uint32(0x9E3779B1)
            row += np.bincount(mixed >> np.uint32(20), minlength=DIMS)
    return out


@dataclass
class Model:
    """idf (DIMS), centroids (k, DIMS) of length one, each one's language, and the least cosine that is accepted: a row for each centroid, a column for each of LENGTHS."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def least_cosine(self, centroid: int, chars: int) -> float:
        return float(np.interp(np.log2(max(chars, 1)), np.log2(LENGTHS), self.least[centroid]))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if known and self.langs:
            near = self.vectors(counts([texts[i] for i in known])) @ self.centroids.T
            for i, k, s in zip(known, near.argmax(1), near.max(1), strict=True):
                out[i] = (self.langs[k], float(min(max(s, 0.0), 1.0)), bool(s < self.least_cosine(k, len(texts[i]))))
        return out


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine, started from rows spread evenly over the sample; empty clusters go."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([m for j in range(len(c)) if (own == j).any() and np.linalg.norm(m := x[own == j].mean(0)) > 0])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def nothing_learned() -> Model:
    return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros((0, len(LENGTHS))))


def fit(docs: DataFrame, *, sample: int = 250, measured: int = 150, clusters: int = 4, slack: float = 0.5, outside: float = 0.05, most_langs: int = 500) -> Model:
    """Learns from about ``sample`` + ``measured`` texts of each language (rows of ``docs``: doc_id, text, lang).

    Null languages, held-out and null ids and texts without letters are left out; of more
    than ``most_langs`` languages, those with the most texts are learned. Both samples
    are taken by a hash of doc_id, so reruns agree; only their feature counts (sparse)
    come to the driver: at most about 2 * (sample + measured * LENGTHS) * languages vectors.

    ``sample`` texts give the centroids, the others the distances: each is cut to each of
    LENGTHS that it has. A text is rejected below ``slack`` of the cosine that all but
    ``outside`` of the language's measured texts of its length reach.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    each = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    rank, role = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)), F.lit(0)
    for r in each.collect():
        # of few texts, the share of each sample
        whole = min(1.0, (sample + measured) / r["n"])
        first = int(whole * sample / (sample + measured) * (1 << 30))
        role = F.when(F.col("lang") == r["lang"], F.when(rank < first, 1).when(rank < int(whole * (1 << 30)), 2).otherwise(0)).otherwise(role)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if has_letter(text):
                    cuts = [(0, text)] if role == 1 else [(n, text[:n]) for n in LENGTHS if len(text) >= n and has_letter(text[:n])]
                    for chars, part in cuts:
                        tf = counts([part])[0]
                        at = np.flatnonzero(tf)
                        out.append((doc_id, lang, chars, at.astype(np.int32), tf[at]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "lang", "chars", "at", "value"])

    wanted = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", role.alias("role"), "text").where("role > 0")
    found = map_batches(wanted, features, "doc_id long, lang string, chars int, at array<int>, value array<float>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["chars"], r["doc_id"], r["at"]))
    if not any(r["chars"] == 0 for r in found):
        return nothing_learned()

    def dense(rows: list[dict]) -> np.ndarray:
        tf = np.zeros((len(rows), DIMS), np.float32)
        for row, r in zip(tf, rows, strict=True):
            row[r["at"]] = r["value"]
        return tf

    learned = [r for r in found if r["chars"] == 0]
    tf = dense(learned)
    model = nothing_learned()
    model.idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x, langs = model.vectors(tf), np.array([r["lang"] for r in learned])
    for lang in sorted(set(langs.tolist())):
        c = spherical_means(x[langs == lang], clusters)
        close = [[float(v) for v in (model.vectors(dense(part)) @ c.T).max(1)] if (part := [r for r in found if r["lang"] == lang and r["chars"] == n]) else [] for n in LENGTHS]
        least = [slack * float(np.quantile(v, outside)) if len(v) >= LEAST_TEXTS else 0.0 for v in close]
        for k in range(1, len(least)):
            least[k] = least[k] or least[k - 1]
        model.centroids = np.concatenate([model.centroids, c])
        model.langs += [lang] * len(c)
        model.least = np.concatenate([model.least, np.repeat([least], len(c), 0)])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter are ``und``, score 0, rejected; so is every
    text if nothing was learned. Only doc_id and text are read; whole texts are used.
    Repeated rows are judged alike, an empty table gives no rows. The model (some
    hundred kB a language) goes to the tasks as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 64):
                out += shared.value.predict(texts[at : at + 64])
            langs, scores, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return map_batches(spread(with_text(docs, "doc_id")), run, SCHEMA)


def identify(docs: DataFrame, **how) -> DataFrame:
    """Fits on ``docs`` and predicts them: doc_id, held_out, lang_pred, score, rejected."""
    return predict(docs, fit(docs, **how)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were: no join, the mask is made where the row is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(place).to_pylist(), []
            for at in range(0, len(texts), 64):
                keep += [not r for _, _, r in shared.value.predict(texts[at : at + 64])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(spread(docs.select(*names)), run, docs.schema)
