"""What several operators share: the shared folder, eager tables and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, in the contracts of all operators.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes that are worked on at once: a batch of Spark's is cut before its texts are unpacked.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
_folders: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none (tests on one machine), a temporary folder of this
    process is set up once and removed at exit; off one machine that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-webstrata-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{str(base).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators write while it lasts are removed at its end: by then results must be written or collected."""
    start = len(_folders)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for own, path in _folders[start:]:
            if own is spark:
                place = hadoop.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        del _folders[start:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of it: lineage ends here,
    and a lost executor costs at most the tasks that it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch in parts of at most BATCH_ROWS rows and BATCH_BYTES bytes, or one row."""
    for batch in batches:
        parts = [batch]
        while parts:
            part = parts.pop()
            if part.num_rows <= 1 or part.num_rows <= BATCH_ROWS and part.nbytes <= BATCH_BYTES:
                yield part
            else:
                half = min(part.num_rows // 2, BATCH_ROWS)
                parts += [part.slice(half), part.slice(0, half)]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over rows with whole texts, a few at a time, whatever batches the session has set."""
    return df.mapInArrow(lambda batches: fn(small_batches(batches)), schema)


def with_text(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the columns that are used; a null text is empty. Extra columns do no harm."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes]:
    """The strings as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
