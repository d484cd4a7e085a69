"""Stored predictions: identity, persistence, latest, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.text import line, sha256

IDENTITY = ("tenant_id", "item_id", "observation_date", "horizon_days", "dataset_version", "feature_definition_version", "snapshot_id", "snapshot_checksum")
#: Not part of a prediction's content.
CARRIED = ("prediction_id", "correlation_id", "recorded_at")


def identity() -> Column:
    """Hash of what a prediction is made from; which predictor made it does not count."""
    return sha256(line(*(F.lower(F.trim(c)) if c in IDENTITY[:2] else F.col(c) for c in IDENTITY)))


def persist(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows with what becomes of each: append, keep (the same is stored) or conflict (other content is)."""
    content = [c for c in new.columns if c not in CARRIED]
    first = new.groupBy("prediction_id").agg(F.min(F.struct(*(c for c in new.columns if c != "prediction_id"))).alias("r"))
    old = stored.select("prediction_id", F.struct(*content).alias("_old"))
    rows = first.select("prediction_id", "r.*").join(old, "prediction_id", "left")
    effect = F.when(F.col("_old").isNull(), "append").when(F.struct(*content).eqNullSafe(F.col("_old")), "keep").otherwise("conflict")
    return rows.withColumn("effect", effect).drop("_old")


def latest(rows: DataFrame, by: tuple[str, ...] = ("tenant_id", "item_id")) -> DataFrame:
    """The row of each key with the greatest (observation_date, recorded_at, prediction_id)."""
    order = Window.partitionBy(*by).orderBy(F.desc("observation_date"), F.desc("recorded_at"), F.desc("prediction_id"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def freshness(predictions: DataFrame, current: DataFrame, status: Column) -> DataFrame:
    """fresh if the current feature rows still hold the prediction's key and the source is complete, else stale;
    unavailable where the source is neither complete nor stale."""
    key = ["tenant_id", "item_id", "observation_date", "snapshot_id"]
    held = predictions.join(current.select(*key).distinct().withColumn("_held", F.lit(True)), key, "left")
    out = F.when(~status.isin("complete", "stale"), "unavailable").when(F.coalesce("_held", F.lit(False)) & (status == "complete"), "fresh").otherwise("stale")
    return held.withColumn("freshness", out).drop("_held")
