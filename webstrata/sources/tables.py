"""Tables between jobs and tasks: the folder that all share, rounds written there, and small inputs dealt to all cores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is small if there is less than this for each core.
CORE_BYTES = 64 << 20


def shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the session names none, a temporary one on one machine, and an error off it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-webstrata-")
        spark.sparkContext.setCheckpointDir(base)
    return str(base).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of it: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def laid_down(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """A reader of ``df``, written once to a folder below ``path`` that is removed at the end.

    For rows that several jobs read: a cache has whole partitions of batches on the heap,
    and where they don't fit, its serializer holds many batches of each task; files need
    one row group a task, and a job reads only its columns.
    """
    spark = df.sparkSession
    own = f"{path}/rows-{uuid.uuid4().hex}"
    try:
        df.write.parquet(own)
        yield spark.read.schema(df.schema).parquet(own)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: as a generator's output, they are not put in place of their names in filters and projections."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table in few files are dealt to all cores, before each costs a while in Python.

    ``df``: a scan with filters and projections. A row group is read by one task, so that
    a small table is one task's work; what is moved is bounded by CORE_BYTES a core.
    Larger tables are read as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * CORE_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
