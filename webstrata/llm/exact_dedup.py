"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of new documents is
digested, its digests that the index lacks are found by a sort-merge anti-join
(the index side is read in place, without a shuffle) and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import WHITE, materialize

#: Rows of ids and digests (some 60 bytes each) that are sent to all tasks at most.
SMALL = 100_000


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """Digests of all documents kept so far: (digest binary, keep_id, batch).

    ``buckets``: of the table; for 100 TB some thousands, so that one bucket of an
    index of 10^11 digests sorts within a task. ``batch``: which arrival an entry is of;
    an arrival that is run again under the same name, as after a failure, does not
    count its own entries as seen. After many arrivals ``compact`` makes each bucket
    one sorted file again.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, firsts: DataFrame, batch: str | None = None) -> DataFrame:
        """Those of ``firsts`` (digest, keep_id, ...; one row a digest) whose digest the index lacks, but for entries of ``batch``."""
        if not self.exists():
            return firsts
        known = self.read() if batch is None else self.read().where(~F.col("batch").eqNullSafe(batch))
        return firsts.join(known.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, firsts: DataFrame, batch: str | None = None) -> None:
        """Adds ``firsts`` (digest, keep_id), but what a run of the same batch has added before."""
        new = self.unseen(firsts) if batch is not None else firsts
        self._write(new.select("digest", "keep_id", F.lit(batch).cast("string").alias("batch")), self.table)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(table)

    def compact(self) -> None:
        """One sorted file a bucket; the old table goes once the new one is written."""
        new = f"{self.table}_{uuid.uuid4().hex}"
        self._write(self.read(), new)
        self.drop()
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of each row; texts that differ in white space only have one digest."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def register(rows: DataFrame, index: DigestIndex) -> None:
    """Appends those digests of ``rows`` (doc_id, digest) that the index lacks, each with its smallest doc_id."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    index.append(index.unseen(firsts))


def exact_dedup(docs: DataFrame, index: DigestIndex, arrivals: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``arrivals``: the documents come in so many batches, by ranges of doc_id, each
    checked against what the index has by then. Of equal texts the smallest doc_id
    stays; if the index had the text before, keep_id is the index's and none stays.
    group_size counts the rows of ``docs``. Null texts are empty texts; a null doc_id
    stays only if its group has no other; of rows that repeat the id that stays, each
    says kept. An empty table gives no rows. Only ids and digests (40 bytes a row)
    are shuffled, never the texts.
    """
    rows = materialize(digests(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    arrivals = arrivals if low is not None else 1
    width = ((high - low) // arrivals + 1) if arrivals > 1 else 1
    for k in range(arrivals):
        batch = F.col("doc_id") < low + (k + 1) * width if k < arrivals - 1 else F.lit(True)
        batch &= F.col("doc_id") >= low + k * width if k else F.lit(True)
        # rows without an id come last, so that they never take the place of one with an id
        batch = F.coalesce(batch, F.lit(k == arrivals - 1))
        register(rows.where(batch), index)
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    firsts = counts.join(index.read().hint("merge"), "digest")
    out = rows.join(firsts, "digest")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def near_or_dealt(small: DataFrame) -> DataFrame:
    """A written table with a hint to send it to all tasks if it is counted to be small; else joins deal it out."""
    return F.broadcast(small) if small.count() <= SMALL else small


def dedup_documents(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one row a text, all columns as they were.

    Rows are judged by digest and id, so that a repeated id with another text is judged by
    its own text; of fully repeated rows one stays. What goes is told by a table of ids and
    digests; texts are shuffled only if more than SMALL rows go, and then once.
    ``batch``: the arrival's name. The index is written before the rows are; under the
    same name the arrival may be run again and gives the same rows.
    """
    rows = materialize(digests(docs), "digests")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    new = materialize(index.unseen(firsts, batch), "unseen")
    index.append(new, batch)
    each = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    stays = (each["digest"] == new["digest"]) & each["doc_id"].eqNullSafe(new["keep_id"])
    ident = (F.col("digest").alias("told"), F.col("doc_id").alias("told_id"))
    gone = materialize(each.join(new, stays, "left_anti").select(*ident), "gone")
    twice = materialize(each.where("times > 1").join(new, stays, "left_semi").select(*ident), "twice")
    own = [f"in_{i}" for i in range(len(docs.columns))]  # no name of a column clashes with those above
    text, doc_id = (own[docs.columns.index(c)] for c in ("text", "doc_id"))
    keyed = docs.toDF(*own).withColumn("digest", F.unhex(F.sha2(normalised(F.col(text)), 256)))
    same = (F.col("digest") == F.col("told")) & F.col(doc_id).cast("long").eqNullSafe(F.col("told_id"))
    kept = keyed.join(near_or_dealt(gone), same, "left_anti")
    if twice.limit(1).count():
        again = near_or_dealt(twice)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id, "digest"]))
    return kept.select(*own).toDF(*docs.columns)
