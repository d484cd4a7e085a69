"""Stores that a stream writes batch by batch, each batch's rows exactly once: predictions, and a feed of changes.

A batch's rows are partitions of its own (dynamic overwrite), so a batch that comes again replaces what it wrote and
nothing else. What a batch does depends on earlier batches only, so it does the same when it comes again, even after
later ones. ``foreachBatch`` gives the numbers: ``stream.writeStream.foreachBatch(store.insert)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.operators.predictions import CARRIED, latest
from eventfold.operators.replay import scoped

BUCKETS = 64


def _write(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


class PredictionStore:
    """Predictions by id, inserted if absent.

    Files are partitioned by a bucket of the id and the batch. Conflicts are looked for in the buckets that a batch has rows
    for, in earlier batches; other files are not read. ``columns``: DDL of a prediction, with prediction_id."""

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.columns = spark, path, buckets, columns
        self.content = [c.split()[0] for c in columns.split(", ") if c.split()[0] not in CARRIED]

    def _bucket(self, value):
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All stored predictions with bucket and batch."""
        schema = f"{self.columns}, bucket int, batch long"
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return reader.parquet(f"{self.path}/rows") if there else self.spark.createDataFrame([], schema)

    def insert(self, new: DataFrame, batch: int) -> DataFrame:
        """(prediction_id, effect) of a batch's ids: append, keep (the same is stored) or conflict (other content is stored, or the
        batch has several contents, of which the smallest counts). Only appended ones are written."""
        names = [c.split()[0] for c in self.columns.split(", ")]
        asked = new.select(*names).withColumn("bucket", self._bucket(F.col("prediction_id")))
        one = asked.groupBy("bucket", "prediction_id").agg(F.min(F.struct(*self.content, *(c for c in CARRIED if c in names and c != "prediction_id"))).alias("r"), F.count_distinct(F.struct(*self.content)).alias("_contents"))
        met = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        old = self.rows().where(F.col("bucket").isin(met) & (F.col("batch") < batch)).select("bucket", "prediction_id", F.struct(*self.content).alias("_old"))
        rows = one.select("bucket", "prediction_id", "r.*", "_contents").join(old, ["bucket", "prediction_id"], "left")
        same = F.struct(*self.content).eqNullSafe(F.col("_old")) & (F.col("_contents") == 1)
        rows = rows.withColumn("effect", F.when(F.col("_old").isNull(), "append").when(same, "keep").otherwise("conflict")).withColumn("batch", F.lit(batch).cast("long"))
        _write(rows.select("prediction_id", "effect", "batch"), f"{self.path}/effects", "batch")
        effects = self.effects().where(F.col("batch") == batch)
        _write(rows.where("effect = 'append'").select(*names, "bucket", "batch").repartition("bucket"), f"{self.path}/rows", "bucket", "batch")
        return effects.select("prediction_id", "effect")

    def effects(self) -> DataFrame:
        kind = next(c.split()[1] for c in self.columns.split(", ") if c.split()[0] == "prediction_id")
        return self.spark.read.schema(f"prediction_id {kind}, effect string, batch long").parquet(f"{self.path}/effects")

    def read(self, tenant_id: str, prediction_id) -> DataFrame:
        """A tenant's prediction by id: one bucket's files are read."""
        one = F.lit(prediction_id)
        return scoped(self.rows(), tenant_id).where((F.col("bucket") == self._bucket(one)) & (F.col("prediction_id") == one))

    def latest(self) -> DataFrame:
        return latest(self.rows())


class Feed:
    """Changes by tenant, each batch of a source shown once; a reader of a tenant goes on from its own cursor."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path, self.columns = spark, path, columns

    def publish(self, source: str, changes: DataFrame, batch: int) -> None:
        """Writes a batch of a source (a query's name); the same batch again replaces itself. Rows without a tenant are not shown."""
        rows = changes.where("tenant_id IS NOT NULL").withColumns({"source": F.lit(source), "batch": F.lit(batch).cast("long")})
        _write(rows.repartition("tenant_id"), self.path, "tenant_id", "source", "batch")

    def after(self, tenant_id: str, cursor: dict[str, int] | None = None) -> DataFrame:
        """A tenant's changes behind its cursor, the last batch that it has seen of each source; only its partitions are read."""
        rows = scoped(self.spark.read.schema(f"{self.columns}, tenant_id string, source string, batch long").parquet(self.path), tenant_id)
        for source, seen in (cursor or {}).items():
            rows = rows.where((F.col("source") != source) | (F.col("batch") > seen))
        return rows

    @staticmethod
    def cursor(rows: DataFrame, before: dict[str, int] | None = None) -> dict[str, int]:
        """The cursor behind some changes: a number for each source."""
        return (before or {}) | {r["source"]: r["last"] for r in rows.groupBy("source").agg(F.max("batch").alias("last")).collect()}
