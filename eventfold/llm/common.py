"""What the operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space that separates words in every contract of this subpackage: blank and \x09 to \x0d.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; all others never leave the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is not set and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return found or os.path.join(tempfile.gettempdir(), "eventfold-shared")


class Written:
    """Intermediate tables in the shared folder, each written once and read again.

    A written table survives the loss of any executor, and a later stage starts from its files
    instead of from the input. ``drop`` removes one as soon as nothing needs it.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc32_text(column: str):
    """Unsigned CRC-32 of a string's UTF-8 bytes; null: of no bytes."""
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary"))


#: Bytes of a batch, about, that are Python objects at a time.
SLICE_BYTES = 4 << 20


def release() -> None:
    """Gives freed memory back: a worker lives on, with the next stage's tables."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def slices(batches) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``SLICE_BYTES``, none empty."""
    for b in batches:
        rows = max(1, b.num_rows * SLICE_BYTES // max(b.nbytes, SLICE_BYTES))
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    release()


def map_rows(df: DataFrame, schema: str, start) -> DataFrame:
    """``df`` through Python, a part of an Arrow batch at a time.

    ``start()`` is called once a task and returns a function from a part, as a dict of lists, to rows.
    Arrow keeps null integers as nulls, which pandas would turn into floats.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = start()
        for b in slices(batches):
            yield batch_of(step(b.to_pydict()), types)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, reads: list[str], added: str, start) -> DataFrame:
    """``df`` with columns added that ``start()``'s function makes from the columns ``reads``, a row for each row.

    Only these become Python objects; all other columns pass through as they came.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
    types, more = to_arrow_schema(schema), to_arrow_schema(StructType.fromDDL(added))
    at = [df.columns.index(c) for c in reads]

    def run(batches):
        step = start()
        for b in slices(batches):
            made = batch_of(step(*(b.column(k).to_pylist() for k in at)), more)
            kept = [c.cast(t.type) for c, t in zip(b.columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*kept, *made.columns], schema=types)

    return df.mapInArrow(run, schema)


def batch_of(rows, types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def map_stream(df: DataFrame, schema: str, make, rows: int = 1000) -> DataFrame:
    """``df`` through Python as one stream of tuples a partition; ``make`` is a generator function over it."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        source = (row for b in slices(batches) for row in zip(*b.to_pydict().values(), strict=True))
        made = make(source)
        while some := list(islice(made, rows)):
            yield batch_of(some, types)
        release()

    return df.mapInArrow(run, schema)


def mixed(x):
    """Unsigned 64-bit numbers (numpy) spread over all bits, by a published mixer's odd constants."""
    x = x * _MIX[0]
    x ^= x >> _MIX[2]
    x *= _MIX[1]
    x ^= x >> _MIX[3]
    return x


_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 32, 29], "u8")


class Memo(dict):
    """What ``make`` returned for strings: the latest ``most`` // 2 of them, and as many that were the latest before."""

    def __init__(self, make, most: int):
        self.make, self.half, self.before = make, most // 2, {}

    def __missing__(self, key: str):
        made = self.before.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = made
        return made


def numbered(df: DataFrame, key: str, deal_by: list[str], order: list[str], name: str, rows: int, bucket_rows: int = 1 << 17) -> DataFrame:
    """``df``, a written table of ``rows`` rows, with gapless numbers from 0 within ``key`` added.

    Rows are numbered within (key, bucket), buckets being dealt by a hash of ``deal_by``; the buckets'
    counts, added up in order, give each its first number. So no task holds all rows of a key.
    """
    buckets = 1 + rows // bucket_rows
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*deal_by), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(key, "_bucket").count().select(key, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    out = dealt.withColumn("_own", own).join(firsts, [key, "_bucket"])
    return out.select(*df.columns, (F.col("_first") + F.col("_own") - 1).alias(name))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, parts: int = 1024) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row, with its number of ``rows``, for each key.

    Groups of more than one part in ``parts`` of all rows, at most that many, are broadcast; the others meet
    their rows in a shuffle join, where no key is larger than that.
    """
    total = groups.agg(F.sum("rows")).first()[0] or 0
    hot = groups.where(F.col("rows") * parts > total)
    found = F.broadcast(hot.drop("rows"))
    cold = groups.where(F.col("rows") * parts <= total).drop("rows")
    return rows.join(found, key).unionByName(rows.join(found.select(key), key, "left_anti").join(cold, key))
