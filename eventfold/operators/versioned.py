"""The events table as a versioned stream of decrements for each item, with deterministic faults.

An item's events in the order of (ts, event_id) are versions 1, 2, ... of it; the quantity after each
follows from the decrements. Faults: every 101st event is never delivered; of the others every 20th is
delivered twice and every 33rd once more with other content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.sources.tables import table

DROPPED = "event_id % 101 = 0"
CONFLICT = "event_id % 33 = 0"
REPEATED = "event_id % 20 = 0"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, item_id, tenant_no, event_type, ts, dec, version, after_qty, before_qty."""
    base = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("item_id"), (F.col("user_id") % 4).alias("tenant_no"), "event_type", "ts",
        F.greatest(F.lit(1).cast("long"), F.round(F.col("value") * 100).cast("long")).alias("dec"),
    )
    item = Window.partitionBy("item_id")
    order = item.orderBy("ts", "event_id")
    so_far = F.sum("dec").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = base.withColumns({"version": F.row_number().over(order).cast("long"), "after_qty": F.sum("dec").over(item) - so_far})
    return out.withColumn("before_qty", F.col("after_qty") + F.col("dec"))


def with_first_missing(rows: DataFrame) -> DataFrame:
    """``rows`` with m, the first version of the item that is never delivered; null if all are.

    A window over the partitioning that ``log`` left, so nothing is shuffled again.
    """
    m = F.min(F.when(F.expr(DROPPED), F.col("version"))).over(Window.partitionBy("item_id"))
    return rows.withColumn("m", m)


def projection(rows: DataFrame) -> DataFrame:
    """Each item's state once all deliveries are folded: that of the last version before the first gap."""
    ok = rows.where("m IS NULL OR version < m")
    return ok.groupBy("tenant_no", "item_id").agg(F.max_by("after_qty", "version").alias("quantity_on_hand"), F.max("version").alias("aggregate_version"))


def dispositions(rows: DataFrame) -> DataFrame:
    """``rows`` that were delivered, with the state their inbox entry ends in."""
    state = (
        F.when(F.expr(CONFLICT), "quarantined_conflict").when(F.col("version") > F.col("m"), "quarantined_gap")
        .when(F.expr(REPEATED), "duplicate_noop").otherwise("applied")
    )
    return rows.where(f"NOT ({DROPPED})").withColumn("disposition", state)


LOG_SQL = """
log AS (
  SELECT *, after_qty + dec AS before_qty FROM (
    SELECT event_id, item_id, tenant_no, event_type, ts, dec,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY ts, event_id) AS BIGINT) AS version,
           CAST(SUM(dec) OVER (PARTITION BY item_id) - SUM(dec) OVER (PARTITION BY item_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS after_qty
    FROM (SELECT event_id, user_id AS item_id, user_id % 4 AS tenant_no, event_type, ts, greatest(CAST(1 AS BIGINT), CAST(round(value * 100) AS BIGINT)) AS dec FROM events) b) l
),
miss AS (SELECT item_id, MIN(version) AS m FROM log WHERE event_id % 101 = 0 GROUP BY item_id),
j AS (SELECT log.*, miss.m FROM log LEFT JOIN miss USING (item_id)),
proj AS (SELECT tenant_no, item_id, max_by(after_qty, version) AS quantity_on_hand, MAX(version) AS aggregate_version FROM j WHERE m IS NULL OR version < m GROUP BY ALL),
disp AS (SELECT *, CASE WHEN event_id % 33 = 0 THEN 'quarantined_conflict' WHEN m IS NOT NULL AND version > m THEN 'quarantined_gap'
         WHEN event_id % 20 = 0 THEN 'duplicate_noop' ELSE 'applied' END AS disposition FROM j WHERE event_id % 101 <> 0)
"""
