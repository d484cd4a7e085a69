"""Ordered passes over sorted partitions, as streams of rows with little state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def values_of(column: pa.Array) -> list:
    """A column's values as ``to_pylist`` gives them, but without a scalar object for each one."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_float64(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
    for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
        values[k] = None
    return values


def map_stream(df: DataFrame, schema: str, make: Callable[[Iterator[tuple]], Iterator[tuple]], rows: int = 4096) -> DataFrame:
    """``df`` as one stream of tuples a partition through a generator function; no group is held in memory."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(row for b in batches for k in range(0, b.num_rows, rows) for row in zip(*map(values_of, b.slice(k, rows).columns), strict=True))
        while some := list(islice(made, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), types, strict=True)], schema=types)

    return df.mapInArrow(run, schema)
