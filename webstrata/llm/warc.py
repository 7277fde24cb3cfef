"""WARC archives: writing records, and reading them back by boundary chains.

Reading: tasks cut a file at every occurrence of the record magic and emit, for each,
its offset and the offset where its record would end by its Content-Length. From
the start of a file, pointer jumping over these pairs marks the records that are
reached; magic inside a payload is never reached and stays payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.llm.common import materialize

MAGIC = "WARC/1.0\r\n"
CRLF2 = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALL = 100_000
#: Rows of one payload are dealt to so many places where payloads are joined by shuffle.
SALTS = 64


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits are four base-32 digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, refers_to) of payloads that several rows have, of at least ``least_bytes`` bytes."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    seen = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows"))
    return seen.where("rows > 1 and refers_to is not null").select("digest", "refers_to")


def write_warc(pages: DataFrame, path: str, *, least_bytes: int = 0, compression: str = "gzip", records_per_file: int = 50_000) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``, by Spark's own text writer.

    Of rows with equal payloads (from ``least_bytes`` on) that with the largest page_id
    is the response, the others are revisits without a payload that refer to it; rows
    that repeat that id are all responses. Null html: an empty payload; null url: an
    empty target. Line ends in urls are escaped. Extra columns are ignored; an empty
    table writes no record. Payloads aren't shuffled unless more than SMALL payloads
    are shared by several rows.
    """
    again = materialize(revisits(pages, least_bytes), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    if again.count() <= SMALL:
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:  # one payload, such as the empty one, may be in a third of all rows
        dealt = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "salt"], "left")
    text = record_text(least_bytes)
    out = rows.select(text.alias("value")).write.option("lineSep", CRLF2).option("maxRecordsPerFile", records_per_file)
    (out.option("compression", compression) if compression else out).text(path)


def record_text(least_bytes: int) -> Column:
    n = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit(CRLF2))
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("html") >= least_bytes)
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), ident(F.col("page_id")), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), ident(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF2),
    )
    return F.concat(head, block)


def content_key() -> list[Column]:
    """What tells a chunk in any evaluation: equal keys are equal bytes."""
    return [F.octet_length("chunk").cast("long").alias("size"), F.xxhash64("chunk").alias("k1"), F.xxhash64(F.lit(10), F.col("chunk")).alias("k2")]


def field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, chunk): the files cut at each magic, which is not part of a chunk; before the first is a chunk, too.

    Spark's reader splits large files, deals the splits out and finds the magic on its own.
    ``block`` and ``no`` order the chunks of one evaluation; another one may split the files
    elsewhere, so that only chunks themselves are the same in both.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.col("value").cast("binary").alias("chunk"))


def parsed(raw: Column) -> dict[str, Column]:
    """Columns of a record from its bytes after the magic, as far as they are complete."""
    text = raw.cast("string")
    head = F.substring_index(text, CRLF2, 1)
    size = F.octet_length(head) + 4
    length = field(head, "Content-Length").try_cast("long")
    block = F.substring(raw, (size + 1).cast("int"), length.cast("int"))
    http = F.substring_index(block.cast("string"), CRLF2, 1)
    payload = F.substring(block, F.octet_length(http) + 5, F.octet_length(block))
    return {
        "page_id": F.regexp_extract(field(head, "WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long"),
        "url": F.coalesce(field(head, "WARC-Target-URI"), F.lit("")),
        "record_type": field(head, "WARC-Type"),
        "refers_to": F.regexp_extract(field(head, "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long"),
        "stated_digest": F.regexp_replace(field(head, "WARC-Payload-Digest"), "^sha1:", ""),
        "http_length": field(http, "Content-Length").try_cast("long"),
        "payload": payload,
        "span": size + length + 4,
    }


def reached(offset: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the candidates (sorted offsets, and where each one's record ends; -1: nowhere) a chain from the first reaches.

    Pointer jumping: the marked set doubles its reach in each round.
    """
    n = len(offset)
    jump = np.searchsorted(offset, end)
    jump = np.where((jump < n) & (offset[np.minimum(jump, n - 1)] == end), jump, n)
    jump = np.append(jump, n)
    mark = np.zeros(n + 1, bool)
    mark[0] = n > 0 and offset[0] == 0
    while True:
        more = mark.copy()
        more[jump[np.flatnonzero(mark)]] = True
        jump = jump[jump]
        if (more == mark).all():
            return mark[:n]
        mark = more


def chain(candidates: DataFrame) -> DataFrame:
    """(file, no, offset, span, record_no, torn): for each candidate the number, in its file, of the record that it is in (negative where it isn't that record's start), and whether that record goes beyond the next magic.

    A file's offsets (24 bytes a candidate) come together, not its payloads.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        offset, span = table["offset"].to_numpy(), table["span"].to_pandas().fillna(-1).to_numpy().astype(np.int64)
        mark = reached(offset, np.where(span >= 0, offset + span, -1))
        number = np.cumsum(mark)
        whole = span <= np.append(offset[1:], np.iinfo(np.int64).max) - offset
        torn = ~whole[np.flatnonzero(mark)[np.maximum(number - 1, 0)]] & (number > 0) if mark.any() else mark
        table = table.append_column("record_no", pa.array(np.where(mark, number, -number), pa.int64()))
        return table.append_column("torn", pa.array(torn, pa.bool_()))

    return candidates.groupBy("file").applyInArrow(run, "file string, no long, offset long, span long, record_no long, torn boolean")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: page_id, url, record_type, refers_to, stated_digest, payload_digest, payload_bytes.

    Digest and length of a response are of the payload bytes that are there; a revisit has
    no payload, its length is what its HTTP head states, its digest what the record states.
    Bytes before the first magic or after the last reached record are left out.
    """
    cut = chunks(spark, path)
    f = parsed(F.col("chunk"))
    columns = ("page_id", "url", "record_type", "refers_to", "stated_digest", "http_length")
    narrow = materialize(
        cut.select(
            "file", "block", "no", *content_key(), (f["span"] + len(MAGIC)).alias("span"), *(f[k].alias(k) for k in columns),
            base32_sha1(f["payload"]).alias("payload_digest"), F.octet_length(f["payload"]).cast("long").alias("payload_bytes"),
        ),
        "chunks",
    )
    order = Window.partitionBy("file").orderBy("block", "no")
    # the first chunk of a file lies before any magic; each later one begins with a magic of its own
    first = F.row_number().over(order) == 1
    offset = F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)) - len(MAGIC)
    placed = narrow.select("file", "no", "size", "span", offset.alias("offset"), first.alias("first")).where(~F.col("first"))
    linked = materialize(chain(placed.select("file", "no", "offset", "span")), "chain")
    whole = narrow.join(linked.where("record_no > 0 and not torn").select("file", "no"), ["file", "no"])
    # records that have the magic inside: their chunks are read again, told by what is in them, and put together
    key = ["file", "size", "k1", "k2"]
    torn = linked.where("torn").select("file", "no", F.abs("record_no").alias("record_no"), "offset")
    torn = materialize(torn.join(narrow.select("no", *key), ["file", "no"]).drop("no"), "torn")
    few = torn.count() <= SMALL
    wanted = torn.select(*key).distinct()
    bytes_ = cut.select("file", *content_key(), "chunk").join(F.broadcast(wanted) if few else wanted, key, "left_semi").dropDuplicates(key)
    parts = torn.join(bytes_, key, "left")
    lost = F.raise_error(F.concat(F.lit("a part of a record is no longer in "), F.col("file"))).cast("binary")
    parts = parts.withColumn("chunk", F.coalesce("chunk", lost))
    joined = parts.groupBy("file", "record_no").agg(F.sort_array(F.collect_list(F.struct("offset", "chunk"))).alias("parts"))
    glue = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0]["chunk"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["chunk"])
    )
    g = parsed(F.col("raw"))
    mended = joined.select(glue.alias("raw")).where("raw is not null").select(
        *(g[k].alias(k) for k in columns), base32_sha1(g["payload"]).alias("payload_digest"), F.octet_length(g["payload"]).cast("long").alias("payload_bytes")
    )
    rows = whole.select(*columns, "payload_digest", "payload_bytes").unionByName(mended)
    again = F.col("record_type") == "revisit"
    return rows.select(
        "page_id", "url", "record_type", "refers_to", "stated_digest",
        F.when(again, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(again, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
    )
