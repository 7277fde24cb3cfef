"""Sequential folds over sorted groups, as streams.

Some choices depend on what was chosen before in the same group. Rows are dealt by
group and sorted within partitions; each partition is read as a stream of Arrow
batches, so a group may be of any size: only its state is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def unpacked(column: pa.Array) -> list:
    """``to_pylist``, without a scalar for each value where types allow it."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], tuple | None], schema: str) -> DataFrame:
    """One output tuple, or none, for each row: ``state = start(first row)`` for a group, then ``step(state, row)``."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            names = batch.schema.names
            for values in zip(*map(unpacked, batch.columns), strict=True):
                row = dict(zip(names, values, strict=False))
                own = tuple(row[k] for k in keys)
                if own != key or state is None:
                    key, state = own, start(row)
                if (found := step(state, row)) is not None:
                    out.append(found)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)
