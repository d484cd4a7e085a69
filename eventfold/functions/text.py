"""Canonical lines and the hashes over them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


def line(*columns) -> Column:
    """The columns as text, tab-separated, with a line feed; nulls are empty, so no field moves."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [x for c in cols for x in (F.lit("\t"), F.coalesce(c.cast("string"), F.lit("")))][1:]
    return F.concat(*parts, F.lit("\n"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ordered_hash(df: DataFrame, by: list[str], lines: Column, *order, name: str = "checksum", head: str = "", tail: str = "") -> DataFrame:
    """One hash for each group over head, its lines in order and tail; without ``by``, one in all, also if there are no rows.

    Lines arrive sorted and are fed to the digest as a stream, so a group of any size needs no array or string.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"_k{i}" for i in range(len(cols))]
    rows = df.select(*by, *(c.alias(k) for c, k in zip(cols, keys, strict=True)), lines.alias("_line"))
    if by:
        rows = rows.repartition(*by)
    else:  # an empty line, so that there is a hash of nothing
        rows = rows.unionByName(df.sparkSession.range(1).select(F.lit("").alias("_line")), allowMissingColumns=True).repartition(1)
    rows = rows.sortWithinPartitions(*by, *keys, "_line").select(*by, "_line")
    schema = StructType([*(rows.schema[c] for c in by), StructField(name, StringType())])
    types, first, last = to_arrow_schema(schema), head.encode(), tail.encode()

    def run(batches):
        group, digest, made = None, None, []
        for b in batches:
            for *own, text in zip(*b.to_pydict().values(), strict=True):
                if digest is None or own != group:
                    if digest is not None:
                        digest.update(last)
                        made.append((*group, digest.hexdigest()))
                    group, digest = own, hashlib.sha256(first)
                digest.update((text or "").encode())
            if len(made) > 1000:
                yield table_of(made)
                made = []
        if digest is not None:
            digest.update(last)
            yield table_of([*made, (*group, digest.hexdigest())])

    def table_of(made):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), types, strict=True)], schema=types)

    return rows.mapInArrow(run, schema)
