"""Tables laid out for how they are asked: in ranges of a key for pages of a listing, in buckets of a key for newest versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators.pages import keyset


def write_ranges(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Writes ``df`` in files of consecutive ranges of ``order``, each sorted, and a manifest: file, first and last key, rows."""
    parts = [files] if files else []
    df.repartitionByRange(*parts, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.struct(*order).alias("key"))
    rows.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/manifest")


def beyond(key: str, order: list[str], after: tuple, descending: bool) -> Column:
    """Whether a key is past a cursor: later, or earlier when listed the other way."""
    past = lambda c, v: F.col(f"{key}.{c}") < F.lit(v) if descending else F.col(f"{key}.{c}") > F.lit(v)
    steps = [reduce(Column.__and__, [*(F.col(f"{key}.{c}") == F.lit(v) for c, v in zip(order[:k], after[:k], strict=True)), past(order[k], after[k])]) for k in range(len(order))]
    return reduce(Column.__or__, steps)


def page_of_ranges(spark: SparkSession, path: str, order: list[str], after: tuple | None, n: int, alive: Column | None = None, descending: bool = False) -> DataFrame:
    """The n + 1 rows after a cursor of a table in ranges: as ``keyset`` gives them, but only the files next to the cursor are read.

    Every file has a row, so that the next n + 2 files are enough if no row is left out;
    fewer are taken where their counts say so. ``alive`` leaves out deleted rows: while
    a page is too short, twice as many files are read. What is read does not grow with
    the table. ``order`` tells all rows apart.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    near, far = ("last", "first") if descending else ("first", "last")
    if after is not None:
        manifest = manifest.where(beyond(far, order, after, descending))
    listed = manifest.orderBy(F.desc(near) if descending else F.asc(near))
    some = n + 2
    while True:
        files = listed.limit(some).select("file", "rows").collect()  # names and counts of the files next to the cursor
        if not files:
            return spark.read.parquet(f"{path}/rows").limit(0)
        enough, have = 1, 0
        while enough < len(files) and have <= n:  # the first file may lie before the cursor but for its last row
            have, enough = have + files[enough]["rows"], enough + 1
        taken = files if some > n + 2 else files[:enough]
        rows = spark.read.parquet(*(f["file"] for f in taken))
        page = keyset(rows if alive is None else rows.where(alive), order, after, n, descending)
        if alive is None or len(files) < some and len(taken) == len(files) or page.count() > n:
            return page
        some *= 2


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int = 64) -> None:
    """Appends rows to a table bucketed and sorted by its logical key, a file a bucket, so that ``current_view`` of it needs no shuffle."""
    spark = df.sparkSession
    place = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and place.startswith("file:") and place.endswith("/spark-warehouse"):
        raise ValueError("spark.sql.warehouse.dir must name a folder that driver and executors share")
    df.repartition(buckets, *keys).write.mode("append").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def compact(spark: SparkSession, table: str, keys: list[str], version: str = "record_version", buckets: int = 64) -> None:
    """Leaves the newest version of each key, tombstones included, in a bucketed table.

    The rows are written to a table of their own, which then takes the old one's name;
    until then the old one is whole.
    """
    rows = spark.table(table)
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row")).select(*keys, "row.*").select(*rows.columns)
    write_bucketed(newest, f"{table}_compacted", keys, buckets)
    spark.sql(f"alter table {table} rename to {table}_old")
    spark.sql(f"alter table {table}_compacted rename to {table}")
    spark.sql(f"drop table {table}_old")
