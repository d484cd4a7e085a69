"""From raw log records to dispositions, failures and projections.

A log has topic, partition, offset, key and value, as Spark's Kafka source gives them. Values are parsed strictly;
what fails becomes a failure row at its position, everything else goes through the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions import canon
from eventfold.operators import fold as R
from eventfold.sources.tables import written

POSITION = ("topic", "partition", "offset")
POISON_ATTEMPTS = 5


def records(parsed: DataFrame, seq: Column) -> DataFrame:
    """The fold's records of what was parsed; ``seq`` is the order of arrival."""
    key = F.col("key").cast("string")
    out = parsed.where("category IS NULL").select(
        seq.cast("long").alias("seq"), key.alias("log_key"), "event_id", "tenant_id", "aggregate_type", "aggregate_id", "version", "before", "after", "parent_id", "order_id", "content_hash"
    )
    return R.columns(R.with_groups(out))


#: Columns of a failure that tell of its event.
IDENTITY = ("event_id", "tenant_id", "event_type", "schema_version", "aggregate_type", "aggregate_id", "version")


def parse_failures(parsed: DataFrame, attempt: Column) -> DataFrame:
    """Attempts to process rejected values, with what the parser recovered of their identity."""
    return parsed.where("category IS NOT NULL").select(
        *POSITION, attempt.alias("attempt"), F.col("category").alias("failure_category"), F.col("rule").alias("diagnostic_code"), "received_hash", *IDENTITY, F.lit("quarantined").alias("status")
    )


def failure_rows(attempts: DataFrame, poison: int = POISON_ATTEMPTS) -> DataFrame:
    """One row for each position from its attempts (``attempt`` orders them; status quarantined, or retrying for a handler's
    poison): the identity and the failure's id are the first attempt's, code and category the last one's. Poison is
    quarantined from its fifth attempt on, and acknowledged then."""
    first = F.min_by(F.struct(*IDENTITY, "received_hash", "status"), "attempt")
    last = F.max_by(F.struct("failure_category", "diagnostic_code"), "attempt")
    rows = attempts.groupBy(*POSITION).agg(first.alias("f"), last.alias("l"), F.count("*").alias("attempt_count"))
    status = F.when((F.col("f.status") == "quarantined") | (F.col("attempt_count") >= poison), "quarantined").otherwise("retrying")
    return rows.select(
        *POSITION, F.sha2(F.concat_ws("/", *(F.col(c).cast("string") for c in POSITION)), 256).alias("failure_id"), "attempt_count", "l.failure_category", "l.diagnostic_code",
        *(f"f.{c}" for c in IDENTITY), "f.received_hash", status.alias("quarantine_status"), (status == "quarantined").alias("acknowledged"),
    )


def process(log: DataFrame, seq: Column) -> tuple[DataFrame, DataFrame]:
    """(failures, changes) of a log: its failure rows, and the change-log of all records that parse. The log is parsed once,
    into a written table that both are read from."""
    parsed = written(canon.parse_log(log, without=("value", "canonical")), "parsed")
    return failure_rows(parse_failures(parsed, seq)), R.fold(records(parsed, seq))


def acknowledged(results: DataFrame) -> DataFrame:
    """How far a consumer may commit each partition: all positions below the first that is not acknowledged.

    ``results``: partition, offset, acknowledged."""
    first = F.min(F.when(~F.col("acknowledged"), F.col("offset")))
    return results.groupBy("partition").agg(F.coalesce(first, F.max("offset") + 1).alias("committed"), F.count_if(~F.col("acknowledged")).alias("open"))
