"""Authorisation by an allow list, and the log of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Scope, role, resource and action that are allowed; nothing else is.
MATRIX = (
    ("tenant-1", "ops_reader", "inventory_projection", "read"),
    ("tenant-1", "ops_reader", "ops_visibility", "read"),
    ("tenant-1", "platform_operator", "ops_visibility", "read"),
    ("tenant-1", "platform_operator", "quarantine", "release"),
    ("tenant-1", "platform_operator", "replay", "replay"),
    ("tenant-1", "platform_operator", "rebuild", "rebuild"),
    ("tenant-1", "platform_operator", "audit", "read"),
    ("tenant-1", "ops_reader", "forecast_features", "read"),
    ("tenant-1", "ops_reader", "forecast_predictions", "read"),
    ("runtime", "release_observer", "release_metrics", "read"),
)


def allowed(spark: SparkSession, assignments: DataFrame) -> DataFrame:
    """Assignments (principal_id, tenant_id, role_id) with each resource and action they allow.

    A principal with any assignment without a tenant, or without a role in a scope, is denied there: incomplete rows
    poison the decision. The list has ten rows and is broadcast.
    """
    matrix = F.broadcast(spark.createDataFrame(MATRIX, "tenant_id string, role_id string, resource string, action string"))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    scopes = assignments.groupBy("principal_id", "tenant_id").agg(F.bool_or(empty("role_id")).alias("no_role"), F.collect_set("role_id").alias("roles"))
    lost = assignments.where(empty("tenant_id")).select("principal_id").distinct()
    good = scopes.where("NOT no_role").join(lost, "principal_id", "left_anti")
    rows = good.select("principal_id", "tenant_id", F.explode("roles").alias("role_id"))
    return rows.join(matrix, ["tenant_id", "role_id"]).distinct()


def decide(spark: SparkSession, requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """Requests (principal_id, tenant_id, resource, action, ...) with outcome allow or deny, as rows for the log."""
    ok = allowed(spark, assignments).select("principal_id", "tenant_id", "resource", "action").distinct().withColumn("_ok", F.lit(True))
    out = requests.join(ok, ["principal_id", "tenant_id", "resource", "action"], "left")
    return out.withColumn("outcome", F.when(F.col("_ok"), "allow").otherwise("deny")).drop("_ok")


def decisions_of(log: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's decisions in the order in which they were recorded."""
    if not (tenant_id or "").strip():
        raise ValueError("a tenant is needed")
    return log.where(F.col("tenant_id") == tenant_id).orderBy("recorded_at", "decision_id")
