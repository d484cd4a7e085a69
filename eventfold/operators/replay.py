"""Rebuilds and comparisons of projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.text import line, ordered_hash
from eventfold.operators.fold import fold, inbox, inventory, with_groups


def scoped(rows: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's rows; without a tenant nothing is read."""
    if not (tenant_id or "").strip():
        raise ValueError("a tenant is needed")
    return rows.where(F.col("tenant_id") == tenant_id)


def inventory_checksum(projection: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    names = ("tenant_id", "item_id")
    rows = projection.withColumns({c: F.lower(c) for c in names})
    return ordered_hash(rows, list(by), line(*names, "quantity_on_hand", "aggregate_version"), *names)


def lineage_checksum(hops: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rows = hops.withColumns({c: F.lower(c) for c in ("tenant_id", "aggregate_id", "parent_id", "order_id")})
    return ordered_hash(rows, list(by), line("aggregate_type", "tenant_id", "aggregate_id", "parent_id", F.lit(""), "order_id", "version", "event_id", F.lit(1)), "aggregate_type", "tenant_id", "aggregate_id")


def rebuild(records: DataFrame, tenant_id: str) -> tuple[DataFrame, DataFrame]:
    """Projection, and one row of status and counts of deliveries, of a tenant's records folded from nothing. The result is written
    beside the old one by the caller; nothing is changed in place."""
    changes = fold(with_groups(scoped(records, tenant_id)))
    own, state = changes.where("own"), F.col("disposition")
    counts = own.agg(
        F.count_if(state == "applied").alias("applied"), F.count_if(state == "duplicate_noop").alias("duplicate_noop"),
        F.count_if(state.startswith("quarantined") & (state != "quarantined_gap")).alias("quarantined"), F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )
    left = inbox(changes).agg(F.count_if(state == "quarantined_gap").alias("gaps"), F.count_if(state.startswith("quarantined") & (state != "quarantined_gap")).alias("ended"))
    complete = (F.col("records") > 0) & (F.col("quarantined") + F.col("ended") + F.col("gaps") == 0)
    return inventory(changes), counts.crossJoin(F.broadcast(left)).withColumn("status", F.when(complete, "complete").otherwise("incomplete")).drop("ended")  # one row each


def compare(projection: DataFrame, replayed: DataFrame) -> DataFrame:
    """Items in which a stored projection and a replay differ, and how."""
    key = ["tenant_id", "item_id"]
    a = projection.select(*key, F.col("quantity_on_hand").alias("aq"), F.col("aggregate_version").alias("av"))
    b = replayed.select(*key, F.col("quantity_on_hand").alias("bq"), F.col("aggregate_version").alias("bv"))
    both = a.join(b, key, "full_outer")
    difference = F.when(F.col("av").isNull(), "missing in projection").when(F.col("bv").isNull(), "missing in replay").when(F.col("av") != F.col("bv"), "version differs").when(F.col("aq") != F.col("bq"), "quantity differs")
    return both.select(*key, difference.alias("difference")).where("difference IS NOT NULL")


def source_status(reasons: DataFrame) -> DataFrame:
    """Status of each tenant from (tenant_id, reason): only stale reasons make it stale, any other incomplete. A row
    with a null reason stands for a tenant without any."""
    cleaned = reasons.withColumn("reason", F.trim("reason"))
    n = cleaned.groupBy("tenant_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.count_if(~F.col("reason").startswith("stale:")).alias("other"), F.count("reason").alias("n"))
    return n.select("tenant_id", F.when(F.col("n") == 0, "complete").when(F.col("other") == 0, "stale").otherwise("incomplete").alias("status"), "reasons")
