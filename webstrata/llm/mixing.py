"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: all words are shared out by weight; no source is asked for more than a
few times its size, the excess goes to the others. Each source's documents are
shuffled by a hash and cut into blocks of equal length. The slots of the schedule
are the points of a golden-ratio sequence mapped through the cumulative weights;
the k-th slot of a source takes its k-th block, epoch after epoch. The slots are the
order of the mix: whatever comes out is told its slot, and texts are laid out by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.llm import wordhash as W
from webstrata.llm.common import map_batches, materialize, utf8, with_text
from webstrata.sources.tables import spread

EPOCHS = 3
#: The golden ratio's fractional part times 2^32, and the range of the sequence.
GOLDEN, RANGE = 2654435769, 1 << 32
#: More sources than this are refused: their table goes to every task.
MOST_SOURCES = 1_000_000
SMALL = 100_000
#: Words in a block.
BLOCK = 1024


def join_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Broadcasts ``small`` (a written table) if it is counted to be small, else joins by shuffle."""
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, on)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash) of each row; size: the number of words; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for t in utf8(batch.column(2)):
                word = ~W.SPACE[np.frombuffer(t, np.uint8)]
                n.append(int(word[:1].sum() + np.count_nonzero(word[1:] & ~word[:-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n, pa.int64()), batch.column(3)], names=["doc_id", "source", "size", "text_hash"])

    rows = with_text(docs, "doc_id", "source").withColumn("text_hash", F.xxhash64("text"))
    return map_batches(spread(rows), run, "doc_id long, source string, size long, text_hash long")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds weight and target to (key, source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. A source's target is
    the smaller of ``epochs`` times its size and its weight times one common factor:
    with the sources by cap over weight, the factor is what is left for those not
    capped, over their weight. One row per source, in one small window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * epochs
    rows = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    rows = rows.withColumn("ratio", cap / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"),
        F.sum("source_size").over(Window.partitionBy()).alias("all_size"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    rows = rows.withColumn("factor", (F.col("all_size") - F.col("capped")) / F.col("weight_left"))
    # the first source, in this order, that its share does not fill sets the factor for it and all after it
    common = F.min(F.when(F.col("factor") <= F.col("ratio"), F.struct("ratio", "factor"))).over(Window.partitionBy())["factor"]
    target = F.least(cap.cast("double"), F.col("weight") * common)
    return rows.select("key", "source", "source_size", "weight", F.coalesce(target, cap.cast("double")).alias("target"))


def key_of(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def stream(rows: DataFrame, seed: int) -> DataFrame:
    """Adds pos: where the row's words begin in its source's shuffled stream.

    A running sum in two steps, so that no source is summed in one task: over ranges of
    the shuffle hash, then within a range.
    """
    n = rows.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / 500)), 2, 24))
    # 40 bits that order a source's documents; the text counts, so that rows without an id are shuffled, too
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key", "text_hash"), F.lit(1 << 40))).withColumn("part", F.shiftright("h", 40 - bits))
    sums = rows.groupBy("key", "part").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "part", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "part").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, ["key", "part"]).withColumn("pos", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("h", "part", "base")


def schedule(spark: SparkSession, sources: DataFrame, block: int) -> DataFrame:
    """(slot, key, epoch, at, words): the slots in order; each takes ``words`` words from ``at`` of its source's stream.

    ``sources``: key, source, source_size, target. A source needs whole epochs of its
    blocks and part of another, together its target in words; the last slot is cut to
    fit. Slots beyond a source's need are left out, slots that the sequence owes a
    source come at the end.
    """
    blocks = F.ceil(F.col("source_size") / block)
    take = F.round("target").cast("long")
    rest = take % F.col("source_size")
    plan = sources.where("source_size > 0").select("key", "source_size", blocks.alias("blocks"), take.alias("take"), rest.alias("rest"))
    plan = plan.withColumn("need", F.floor(F.col("take") / F.col("source_size")) * F.col("blocks") + F.ceil(F.col("rest") / block))
    plan = materialize(plan, "plan")
    if (n := plan.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources; {MOST_SOURCES} at most")
    table = sorted((r["key"], r["need"]) for r in plan.select("key", "need").collect())
    total = sum(need for _, need in table)
    keys, upto = [k for k, _ in table], np.cumsum([need for _, need in table]).astype(np.float64) * (RANGE / max(total, 1))
    shared = spark.sparkContext.broadcast((keys, upto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, upto = shared.value
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = (slot % (1 << 31)) * GOLDEN % RANGE
            own = np.minimum(np.searchsorted(upto, point, side="right"), len(keys) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(keys, object)[own], pa.string())], names=["slot", "key"])

    points = spark.range(0, total).mapInArrow(run, "slot long, key string").withColumn("part", F.shiftright("slot", 10))
    sums = points.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "part").orderBy("slot")
    ranked = points.join(base, ["key", "part"]).select("slot", "key", (F.col("base") + F.row_number().over(within) - 1).alias("rank"))
    had = sums.groupBy("key").agg(F.sum("n").alias("had"))
    owed = plan.join(had, "key", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    late = owed.select("key", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"))
    # no more than the sequence's discrepancy: a few for each source
    late = late.select((F.lit(total) + F.row_number().over(Window.orderBy("rank", "key")) - 1).alias("slot"), "key", "rank")
    slots = join_small(ranked.unionByName(late), plan, ["key"]).where("rank < need")
    at = (F.col("rank") % F.col("blocks")) * block
    last = (F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0)
    end = F.least(at + block, F.when(last, F.col("rest")).otherwise(F.col("source_size")))
    return slots.select("slot", "key", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), at.alias("at"), (end - at).alias("words"))


def scheduled(docs: DataFrame, epochs: int, seed: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, pieces): the rows with pos; the sources with targets; (key, pos, epoch, slot, start, words), what each slot takes of a row.

    ``start``: the row's words before the piece. Rows with words are told by key and pos.
    """
    rows = materialize(sizes(docs).withColumn("key", key_of(F.col("source"))), "sizes")
    sources = materialize(targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), epochs), "sources")
    placed = materialize(stream(rows, seed), "stream")
    first, last = F.col("pos") - F.col("pos") % block, F.col("pos") + F.col("size") - 1
    parts = placed.where("size > 0").select("key", "pos", "size", F.explode(F.sequence(first, last, F.lit(block).cast("long"))).alias("at"))
    joined = parts.join(schedule(docs.sparkSession, sources, block), ["key", "at"])
    start = F.greatest(F.col("at") - F.col("pos"), F.lit(0))
    words = F.least(F.col("pos") + F.col("size"), F.col("at") + F.col("words")) - F.greatest("pos", "at")
    pieces = joined.select("key", "pos", "epoch", "slot", start.alias("start"), words.alias("words")).where("words > 0")
    return placed, sources, materialize(pieces, "pieces")


def mix(docs: DataFrame, *, epochs: int = EPOCHS, seed: int = 9, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, slots, first_slot.

    ``taken``: words of the document in the slots of the schedule, repeats counted;
    ``slots``: how many have some of it, ``first_slot``: the first of them. Null
    texts have size 0 and take 0, a null source is a source of its own, null ids are
    rows like others; extra columns are ignored; an empty table gives no rows. Rows
    that repeat lie next to each other in the stream. Reruns agree: the order is a
    hash of doc_id, text and seed.
    """
    placed, sources, pieces = scheduled(docs, epochs, seed, block)
    taken = pieces.groupBy("key", "pos").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("slots"), F.min("slot").alias("first_slot"))
    # rows without words share a position with the row after them, and take nothing
    none = F.lit(0).cast("long")
    out = placed.where("size > 0").join(taken, ["key", "pos"], "left").drop("pos")
    out = out.unionByName(placed.where("size = 0").drop("pos").withColumns({"taken": none, "slots": none, "first_slot": F.lit(None).cast("long")}))
    out = join_small(out.drop("source"), sources, ["key"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "source", "size", "source_size", "target", zero("taken"), zero("slots"), "first_slot")


def with_rows(docs: DataFrame, placed: DataFrame, plan: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` joined with the plan's rows for them (key, pos, ...), and the names that its own columns have in the result.

    A row is told by id, source and text; of rows equal in all three, by a number.
    """
    own = [f"in_{i}" for i in range(len(docs.columns))]
    col = {c: F.col(n) for c, n in zip(docs.columns, own, strict=True)}
    ident = lambda c: {"row_id": F.coalesce(c.cast("long"), F.lit(0).cast("long")), "no_id": c.isNull()}
    on = ["row_id", "no_id", "key", "text_hash"]
    rows = placed.where("size > 0").withColumns(ident(F.col("doc_id")))
    text = docs.toDF(*own).withColumns({**ident(col["doc_id"]), "key": key_of(col["source"]), "text_hash": F.xxhash64(F.coalesce(col["text"], F.lit("")))})
    if rows.groupBy(*on).count().where("count > 1").limit(1).count():
        same = Window.partitionBy(*on)
        rows, text = rows.withColumn("copy", F.row_number().over(same.orderBy("pos"))), text.withColumn("copy", F.row_number().over(same.orderBy(F.lit(1))))
        on = [*on, "copy"]
    wanted = materialize(rows.select(*on, "pos", "size").join(plan, ["key", "pos"]), "wanted")
    # by merge at any size: what is moved is in proportion to the texts
    return text.join(wanted.hint("merge"), on), own


def first_words(text: Column, start: Column, words: Column) -> Column:
    """``words`` words of a text from ``start`` on, with one space between."""
    return F.concat_ws(" ", F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), (start + 1).cast("int"), words.cast("int")))


def mixed_blocks(docs: DataFrame, *, epochs: int = EPOCHS, seed: int = 9, block: int = BLOCK) -> DataFrame:
    """The mix as blocks, in the order of their slots: slot, doc_id, source, start, words, text.

    A row is what one block has of one document: ``words`` words after the first ``start``.
    Edge cases as in ``mix``; a block is cut at documents' and sources' ends.
    """
    placed, _, pieces = scheduled(docs, epochs, seed, block)
    rows, own = with_rows(docs, placed, pieces)
    col = {c: F.col(n) for c, n in zip(docs.columns, own, strict=True)}
    out = rows.select("slot", col["doc_id"].cast("long").alias("doc_id"), col["source"].alias("source"), "start", "words", first_words(col["text"], F.col("start"), F.col("words")).alias("text"), "pos")
    return out.orderBy("slot", "pos").drop("pos")


def mixed_documents(docs: DataFrame, *, epochs: int = EPOCHS, seed: int = 9, block: int = BLOCK) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, all columns as they were, in the order of the schedule.

    A copy of a document lies where the slot that takes its first words is. A document
    taken one and a half times comes twice: whole, and with the first half of its words.
    Only the last block of a source cuts a document, so such parts are few; n_chars, where
    there is one, follows the text. Rows without words are not taken.
    """
    placed, _, pieces = scheduled(docs, epochs, seed, block)
    copies = pieces.groupBy("key", "pos", "epoch").agg(F.min(F.struct("start", "slot")).alias("first"), F.sum("words").alias("words"))
    copies = copies.select("key", "pos", F.col("first.slot").alias("slot"), "words")
    rows, own = with_rows(docs, placed, copies)
    col = {c: F.col(n) for c, n in zip(docs.columns, own, strict=True)}
    part = F.col("words") < F.col("size")
    out = {c: col[c] for c in docs.columns}
    out["text"] = F.when(part, first_words(col["text"], F.lit(0), F.col("words"))).otherwise(col["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(part, F.length(out["text"])).otherwise(col["n_chars"]).cast(docs.schema["n_chars"].dataType)
    rows = rows.orderBy("slot", "pos", "words")
    return rows.select(*(out[c].alias(c) for c in docs.columns))
