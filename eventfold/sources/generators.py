"""Deterministic inputs: a daily history and its series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENANTS = ("11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222")
# Tenant, item, initial quantity, demand on weekdays and at weekends, weekday (Monday is 0) and amount of restocking.
SERIES = (
    (TENANTS[0], "item-flour-001", 80, 7, 2, 0, 30),
    (TENANTS[0], "item-yeast-001", 6, 3, 1, 4, 10),
    (TENANTS[0], "item-salt-001", 100, 1, 1, 0, 10),
    (TENANTS[1], "item-flour-001", 400, 1, 1, 0, 20),
)
START, DAYS = "2026-01-05", 112


def history(spark: SparkSession, series=SERIES, start: str = START, days: int = DAYS) -> DataFrame:
    """tenant_id, item_id, as_of_date, quantity_on_hand: each day restocked first, then demanded, never below nothing.

    The floor makes this a fold over the days, which one ``aggregate`` does for each series.
    """
    rows = spark.createDataFrame(list(series), "tenant_id string, item_id string, initial long, weekday long, weekend long, restock_day int, restock long")
    first = F.lit(start).cast("date")
    calendar = F.sequence(first, F.date_add(first, days - 1))
    zero = F.struct(F.col("initial").alias("left"), F.array().cast("array<struct<d:date,q:bigint>>").alias("out"))

    def step(acc, d):
        got = acc["left"] + F.when(F.weekday(d) == F.col("restock_day"), F.col("restock")).otherwise(0)
        left = F.greatest(F.lit(0).cast("long"), got - F.when(F.weekday(d) >= 5, F.col("weekend")).otherwise(F.col("weekday")))
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(F.struct(d.alias("d"), left.alias("q")))).alias("out"))

    folded = rows.select("tenant_id", "item_id", F.explode(F.aggregate(calendar, zero, step)["out"]).alias("o"))
    return folded.select("tenant_id", "item_id", F.col("o.d").alias("as_of_date"), F.col("o.q").alias("quantity_on_hand"))
