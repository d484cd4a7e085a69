"""The log as a stream: files in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_log(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of log files as a stream, some files a batch; offsets advance when a batch has been committed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
