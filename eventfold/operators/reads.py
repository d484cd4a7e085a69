"""Reads by key and in order, guards on values, and small rules of the operational surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions import canon
from eventfold.operators.replay import scoped
from eventfold.operators.series import SPLITS, dataset, feature_snapshot, normalised

# Counter families with the values that their label may have.
COUNTERS = {
    "publish": ("published", "failure", "quarantined", "ambiguous"), "processing": ("applied", "duplicate_noop", "quarantined", "failure"), "replay": ("complete", "incomplete", "failure"),
    "release": ("released", "not_releasable", "not_found", "failure"), "forecast": ("predicted", "abstained", "failure"), "http": ("2xx", "4xx", "5xx"),
}


def point(rows: DataFrame, tenant_id: str, **key: object) -> DataFrame:
    """A tenant's row with a key: the filters reach the scan. Without a tenant nothing is read."""
    rows = scoped(rows, tenant_id)
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def predictions_in_order(rows: DataFrame, tenant_id: str) -> DataFrame:
    return scoped(rows, tenant_id).orderBy("recorded_at", "prediction_id")


def assignments(texts: DataFrame, column: str = "value") -> DataFrame:
    """(principal_id, tenant_id, role_id, problem) of lists ``principal|tenant|role, ...``: all entries of a list whose entries
    are sound; of any other one row with its first problem; of a blank list none."""
    lists = texts.where(F.trim(column) != "").select(F.transform(F.split(column, ","), lambda e: F.transform(F.split(e, r"\|"), lambda x: F.trim(x))).alias("entries"))
    wrong = lambda p: F.when(F.size(p) != 3, "assignment must be principal|tenant|role").when(F.exists(p, lambda x: x == ""), "assignment contains an empty field")
    rows = lists.withColumn("problem", F.get(F.array_compact(F.transform("entries", wrong)), F.lit(0)))
    entries = rows.select("problem", F.explode(F.when(F.col("problem").isNull(), F.col("entries")).otherwise(F.array(F.array().cast("array<string>")))).alias("p"))
    part = lambda k: F.get("p", F.lit(k))
    return entries.select(part(0).alias("principal_id"), part(1).alias("tenant_id"), part(2).alias("role_id"), "problem")


def age_seconds(now: Column, then: Column) -> Column:
    """Whole seconds since a time, never below zero; zero for none."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.unix_seconds(now) - F.unix_seconds(then), F.lit(0)))


def fresh_session(now: Column) -> Column:
    """Whether a session (principal_id, tenant_id, expires_at) is not over and names someone."""
    named = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.coalesce(now < F.col("expires_at"), F.lit(False)) & named("principal_id") & named("tenant_id")


def outcome_class(code: Column) -> Column:
    return F.when(code.between(200, 299), "2xx").when(code.between(400, 499), "4xx").when(code.between(500, 599), "5xx").otherwise("other")


def counters(events: DataFrame, families: dict[str, tuple[str, ...]] = COUNTERS) -> DataFrame:
    """(family, outcome, n) of events (family, outcome): every allowed value of every family, zero where nothing was counted;
    values outside the lists are not counted."""
    pairs = [(f, o) for f, values in families.items() for o in values]
    allowed = events.sparkSession.createDataFrame(pairs, "family string, outcome string")
    counted = events.groupBy("family", "outcome").agg(F.count("*").alias("n"))
    return F.broadcast(allowed).join(counted, ["family", "outcome"], "left").select("family", "outcome", F.coalesce("n", F.lit(0)).alias("n"))


def effects_json(rows: DataFrame, by: str, effect: str) -> DataFrame:
    """For each key one JSON object of the numbers of rows by effect, in the order of their names."""
    counts = rows.groupBy(by, effect).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(effect).alias("k"), "n")))
    return counts.groupBy(by).agg(entries.alias("e")).select(by, F.to_json(F.map_from_entries("e")).alias("effects"))


def write_keyed(rows: DataFrame, path: str, partitions: int) -> None:
    """A log of files: records of one aggregate key in one partition, in the order of their version."""
    key = F.concat_ws("/", "tenant_id", "aggregate_type", "aggregate_id")
    dealt = rows.withColumn("key", key.cast("binary")).withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    dealt.repartition(partitions, "partition").sortWithinPartitions("partition", "key", "version").write.mode("append").partitionBy("partition").parquet(path)


def insufficient_snapshot(spark: SparkSession, header: dict, status: str, reasons: tuple[str, ...]) -> DataFrame:
    """The snapshot of a source that is not complete: no rows, cleaned reasons; an unknown status is incomplete."""
    kept = status if status in ("stale", "incomplete", "insufficient") else "incomplete"
    empty = spark.createDataFrame([], "row_id string, tenant_id string, item_id string, as_of_date date, source_cutoff_date date, split string, quantity_on_hand long, history_hash string")
    return feature_snapshot(empty, header | {"status": kept}, reasons).withColumn("status", F.lit(kept))


def snapshot_rows(history: DataFrame, cutoff: str, protocol: str, splits=SPLITS) -> DataFrame:
    """Feature rows of what had been observed by a date: cut before labels are made, so the last days have none."""
    return dataset(normalised(history).where(F.col("as_of_date") <= F.lit(cutoff).cast("date")), protocol, splits)


def lineage_events(spark: SparkSession, chains: int) -> DataFrame:
    """Deterministic chains supplier, lot, batch, shipment, each event caused by the one before, as records of the fold."""
    kinds = ("supplier", "ingredient_lot", "production_batch", "shipment")
    name = lambda k: F.concat(F.lit(f"{kinds[k]}-"), F.col("id").cast("string"))
    no = F.lit(None).cast("string")
    hop = lambda k: F.struct(F.lit(kinds[k]).alias("aggregate_type"), name(k).alias("aggregate_id"), (name(k - 1) if k else no).alias("parent_id"), (F.concat(F.lit("order-"), F.col("id").cast("string")) if k == 3 else no).alias("order_id"), F.concat(F.lit("event-"), name(k)).alias("event_id"), (F.concat(F.lit("event-"), name(k - 1)) if k else no).alias("causation_id"))
    rows = spark.range(chains).select(F.lit("tenant-1").alias("tenant_id"), F.explode(F.array(*map(hop, range(4)))).alias("h"))
    return rows.select("tenant_id", "h.*", F.lit(1).cast("long").alias("version"), F.sha2(F.col("h.event_id"), 256).alias("content_hash"))


def supported(family: Column) -> Column:
    """Whether an event type is one that the consumer applies."""
    return F.coalesce(family.isin(*canon.FAMILIES), F.lit(False))


def checkpoint_probe(stores: dict[str, DataFrame]) -> DataFrame:
    """Per event (tenant_id, event_id), which stores hold it and in what state: a column of each store, null where it has none.

    ``stores``: name to rows (tenant_id, event_id, state). They are one tagged union with one aggregation, so an event that
    any store lacks needs no outer join; of several rows of an event in a store the greatest state is told."""
    rows = None
    for name, store in stores.items():
        own = store.select("tenant_id", "event_id", F.lit(name).alias("store"), "state")
        rows = own if rows is None else rows.unionByName(own)
    told = [F.max(F.when(F.col("store") == name, F.col("state"))).alias(name) for name in stores]
    return rows.groupBy("tenant_id", "event_id").agg(*told, F.count_distinct("store").alias("n_stores"))
