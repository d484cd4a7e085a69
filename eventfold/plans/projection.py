"""Queries over the versioned stream: projections, checksums, dispositions, gaps, conflicts, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions.text import line, ordered_hash, sha256
from eventfold.operators import versioned as V
from eventfold.plans.registry import query

WITH = "WITH " + V.LOG_SQL


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return V.with_first_missing(V.log(spark, d))


def _stamp(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("q01_inventory_snapshot", WITH + "SELECT * FROM proj")
def q01(spark, d):
    return V.projection(_rows(spark, d))


@query("q02_inventory_checksum_by_tenant", WITH + """
SELECT tenant_no, sha256(string_agg(tenant_no || chr(9) || item_id || chr(9) || quantity_on_hand || chr(9) || aggregate_version || chr(10), '' ORDER BY CAST(item_id AS VARCHAR))) AS checksum
FROM proj GROUP BY tenant_no""")
def q02(spark, d):
    lines = line("tenant_no", "item_id", "quantity_on_hand", "aggregate_version")
    return ordered_hash(q01(spark, d), ["tenant_no"], lines, F.col("item_id").cast("string"))


@query("q03_inbox_dispositions", WITH + "SELECT event_id, disposition FROM disp")
def q03(spark, d):
    return V.dispositions(_rows(spark, d)).select("event_id", "disposition")


GAPS = "gaps AS (SELECT event_id, item_id, tenant_no, ts, m AS expected_version, version AS received_version FROM disp WHERE disposition = 'quarantined_gap')"


def _gaps(spark, d):
    rows = V.dispositions(_rows(spark, d)).where("disposition = 'quarantined_gap'")
    return rows.select("event_id", "item_id", "tenant_no", "ts", F.col("m").alias("expected_version"), F.col("version").alias("received_version"))


@query("q04_residual_gaps", WITH + "," + GAPS + "SELECT event_id, item_id, expected_version, received_version FROM gaps")
def q04(spark, d):
    return _gaps(spark, d).drop("ts", "tenant_no")


@query("q05_gap_sample_oldest20", WITH + "," + GAPS + "SELECT event_id, item_id, expected_version, received_version FROM gaps ORDER BY ts, event_id LIMIT 20")
def q05(spark, d):
    return _gaps(spark, d).orderBy("ts", "event_id").limit(20).drop("ts", "tenant_no")


DELIVERED = """, delivered AS (
  SELECT event_id, sha256(item_id || chr(9) || version || chr(9) || dec || chr(9) || after_qty || chr(10)) AS h FROM log WHERE event_id % 101 <> 0
  UNION ALL SELECT event_id, sha256(item_id || chr(9) || version || chr(9) || dec || chr(9) || after_qty || chr(10)) FROM log WHERE event_id % 101 <> 0 AND event_id % 20 = 0
  UNION ALL SELECT event_id, sha256(item_id || chr(9) || version || chr(9) || (dec + 1) || chr(9) || (after_qty - 1) || chr(10)) FROM log WHERE event_id % 101 <> 0 AND event_id % 33 = 0)
"""


@query("q06_event_identity_conflicts", WITH + DELIVERED + "SELECT event_id, count(DISTINCT h) AS n_hashes, count(*) AS n_deliveries FROM delivered GROUP BY event_id HAVING count(DISTINCT h) > 1")
def q06(spark, d):
    rows = V.log(spark, d).where(f"NOT ({V.DROPPED})")
    once = F.array(F.struct(F.lit(0).alias("off")))
    copies = F.concat(once, F.when(F.expr(V.REPEATED), once).otherwise(F.array().cast("array<struct<off:int>>")), F.when(F.expr(V.CONFLICT), F.array(F.struct(F.lit(1).alias("off")))).otherwise(F.array().cast("array<struct<off:int>>")))
    rows = rows.withColumn("c", F.explode(copies))
    h = sha256(line("item_id", "version", F.col("dec") + F.col("c.off"), F.col("after_qty") - F.col("c.off")))
    counted = rows.select("event_id", h.alias("h")).groupBy("event_id").agg(F.count_distinct("h").alias("n_hashes"), F.count("*").alias("n_deliveries"))
    return counted.where("n_hashes > 1")


CANONICAL = """'{"aggregate_id":"item-' || item_id || '","aggregate_type":"inventory_item","aggregate_version":' || version || ',"event_id":"' || event_id || '","event_type":"' || event_type
 || '","occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z","payload":{"quantity_after":' || after_qty || ',"quantity_before":' || before_qty || ',"quantity_decremented":' || dec || '}}'"""


@query("q07_content_hash_events", WITH + f"SELECT event_id, sha256({CANONICAL}) AS content_hash FROM log")
def q07(spark, d):
    """Struct fields in canonical order, so the writer's order is the canonical one."""
    body = F.to_json(F.struct(
        F.concat(F.lit("item-"), "item_id").alias("aggregate_id"), F.lit("inventory_item").alias("aggregate_type"), F.col("version").alias("aggregate_version"),
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
        F.struct(F.col("after_qty").alias("quantity_after"), F.col("before_qty").alias("quantity_before"), F.col("dec").alias("quantity_decremented")).alias("payload"),
    ))
    return V.log(spark, d).select("event_id", sha256(body).alias("content_hash"))


@query("q08_contract_violations", WITH + """, mutated AS (
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'inventory.unknown' ELSE 'inventory.quantity_decremented' END AS event_type,
    CASE WHEN event_id % 13 = 0 THEN 'TENANT-' ELSE 'tenant-' END || tenant_no AS tenant_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE version END AS version,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 19 = 0 THEN '+00:00' ELSE 'Z' END AS occurred_at, before_qty, dec, after_qty + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS after_qty FROM log
), judged AS (SELECT event_id, CASE WHEN event_type <> 'inventory.quantity_decremented' THEN 'unsupported event type' WHEN tenant_id <> lower(tenant_id) THEN 'tenant not lower case'
  WHEN version < 1 OR version > 9007199254740991 THEN 'version out of range' WHEN occurred_at NOT LIKE '%Z' THEN 'time not in Z' WHEN before_qty - dec <> after_qty THEN 'arithmetic' END AS rule FROM mutated)
SELECT event_id, rule FROM judged WHERE rule IS NOT NULL""")
def q08(spark, d):
    nth = lambda n: F.col("event_id") % n == 0
    m = V.log(spark, d).select(
        "event_id", F.when(nth(23), "inventory.unknown").otherwise("inventory.quantity_decremented").alias("event_type"),
        F.concat(F.when(nth(13), "TENANT-").otherwise("tenant-"), F.col("tenant_no").cast("string")).alias("tenant_id"), F.when(nth(7), 0).otherwise(F.col("version")).alias("version"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(nth(19), "+00:00").otherwise("Z")).alias("occurred_at"), "before_qty", "dec", (F.col("after_qty") + nth(17).cast("int")).alias("after_qty"),
    )
    rule = (
        F.when(F.col("event_type") != "inventory.quantity_decremented", "unsupported event type").when(F.col("tenant_id") != F.lower("tenant_id"), "tenant not lower case")
        .when(~F.col("version").between(1, 2**53 - 1), "version out of range").when(~F.col("occurred_at").endswith("Z"), "time not in Z").when(F.col("before_qty") - F.col("dec") != F.col("after_qty"), "arithmetic")
    )
    return m.select("event_id", rule.alias("rule")).where("rule IS NOT NULL")


@query("q09_aggregate_key_partition_counts", "SELECT user_id % 8 AS partition_no, count(*) AS n_events, count(DISTINCT 'tenant-' || (user_id % 4) || '/inventory_item/' || user_id) AS n_keys FROM events GROUP BY ALL")
def q09(spark, d):
    key = F.concat_ws("/", F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")), F.lit("inventory_item"), F.col("user_id").cast("string"))
    keys = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 8).alias("partition_no"), key.alias("key")).groupBy("partition_no", "key").count()
    return keys.groupBy("partition_no").agg(F.sum("count").alias("n_events"), F.count("*").alias("n_keys"))


@query("q10_transition_replay_reasons", WITH + """, r AS (
  SELECT item_id, 'incomplete:version gap, expected ' || m AS reason FROM disp WHERE version > m UNION SELECT item_id, 'stale:identity conflict' FROM disp WHERE disposition = 'quarantined_conflict')
SELECT item_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM r GROUP BY item_id""")
def q10(spark, d):
    rows = V.dispositions(_rows(spark, d))
    found = F.array_compact(F.array(
        F.when(F.col("version") > F.col("m"), F.concat(F.lit("incomplete:version gap, expected "), F.col("m").cast("string"))), F.when(F.expr(V.CONFLICT), F.lit("stale:identity conflict"))
    ))
    return rows.select("item_id", F.explode(found).alias("reason")).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))


@query("q11_projection_vs_replay_diff", WITH + """, replay AS (SELECT tenant_no, item_id, max_by(after_qty, version) AS q, max(version) AS v FROM log GROUP BY ALL),
c AS (SELECT coalesce(p.item_id, r.item_id) AS item_id, CASE WHEN p.item_id IS NULL THEN 'missing in projection' WHEN r.item_id IS NULL THEN 'missing in replay'
  WHEN p.aggregate_version <> r.v THEN 'version differs' WHEN p.quantity_on_hand <> r.q THEN 'quantity differs' END AS difference FROM proj p FULL JOIN replay r ON p.item_id = r.item_id AND p.tenant_no = r.tenant_no)
SELECT item_id, difference FROM c WHERE difference IS NOT NULL""")
def q11(spark, d):
    """Both states of an item come from one pass over its rows; only a comparison of stored states needs a join (``operators.replay``)."""
    rows = _rows(spark, d)
    ok = F.col("m").isNull() | (F.col("version") < F.col("m"))
    own = F.when(ok, F.col("version"))
    both = rows.groupBy("tenant_no", "item_id").agg(F.max_by("after_qty", own).alias("pq"), F.max(own).alias("pv"), F.max_by("after_qty", "version").alias("q"), F.max("version").alias("v"))
    difference = F.when(F.col("pv").isNull(), "missing in projection").when(F.col("pv") != F.col("v"), "version differs").when(F.col("pq") != F.col("q"), "quantity differs")
    return both.select("item_id", difference.alias("difference")).where("difference IS NOT NULL")


@query("q12_source_status_by_tenant", WITH + """SELECT tenant_no, CASE WHEN n_gap > 0 THEN 'incomplete' WHEN n_conflict > 0 THEN 'stale' ELSE 'complete' END AS status, n_gap, n_conflict FROM (
  SELECT tenant_no, count(*) FILTER (disposition = 'quarantined_gap') AS n_gap, count(*) FILTER (disposition = 'quarantined_conflict') AS n_conflict FROM disp GROUP BY tenant_no) x""")
def q12(spark, d):
    n = V.dispositions(_rows(spark, d)).groupBy("tenant_no").agg(F.count_if(F.col("disposition") == "quarantined_gap").alias("n_gap"), F.count_if(F.col("disposition") == "quarantined_conflict").alias("n_conflict"))
    return n.withColumn("status", F.when(F.col("n_gap") > 0, "incomplete").when(F.col("n_conflict") > 0, "stale").otherwise("complete"))


@query("q14_processing_counts_by_tenant", WITH + """SELECT tenant_no, count(*) FILTER (disposition = 'applied') AS applied, count(*) FILTER (disposition = 'duplicate_noop') AS duplicate_noop,
  count(*) FILTER (disposition = 'quarantined_conflict') AS quarantined_conflict, count(*) FILTER (disposition = 'quarantined_gap') AS quarantined_gap, CAST(0 AS BIGINT) AS quarantined_stale,
  count(*) FILTER (event_type = 'error' AND event_id % 5 <> 0) AS failures_retrying, count(*) FILTER (event_type = 'error' AND event_id % 5 = 0) AS failures_quarantined,
  strftime(min(ts) FILTER (disposition = 'quarantined_gap'), '%Y-%m-%d %H:%M:%S.%f') AS oldest_gap FROM disp GROUP BY tenant_no""")
def q14(spark, d):
    kinds = ("applied", "duplicate_noop", "quarantined_conflict", "quarantined_gap", "quarantined_stale")
    failed, fifth = F.col("event_type") == "error", F.col("event_id") % 5 == 0
    return V.dispositions(_rows(spark, d)).groupBy("tenant_no").agg(
        *(F.count_if(F.col("disposition") == k).alias(k) for k in kinds), F.count_if(failed & ~fifth).alias("failures_retrying"), F.count_if(failed & fifth).alias("failures_quarantined"),
        F.date_format(F.min(F.when(F.col("disposition") == "quarantined_gap", F.col("ts"))), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("oldest_gap"),
    )


@query("q15_oldest_failure_sample", "SELECT event_id, user_id % 4 AS tenant_no, 'diagnostic-' || (event_id % 5) AS code, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20")
def q15(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").orderBy("ts", "event_id").limit(20)
    return rows.select("event_id", (F.col("user_id") % 4).alias("tenant_no"), F.concat(F.lit("diagnostic-"), (F.col("event_id") % 5).cast("string")).alias("code"), _stamp().alias("at"))


@query("q23_parent_first_event", WITH + "SELECT item_id, min_by(event_id, version) AS parent_event_id, min(version) AS parent_version FROM log GROUP BY item_id")
def q23(spark, d):
    return V.log(spark, d).groupBy("item_id").agg(F.min_by("event_id", "version").alias("parent_event_id"), F.min("version").alias("parent_version"))


@query("q48_replay_metadata", WITH + """, pos AS (SELECT disp.*, item_id % 8 AS partition_no, row_number() OVER (PARTITION BY item_id % 8 ORDER BY ts, event_id) - 1 AS pos FROM disp)
SELECT partition_no, min(pos) AS first_offset, max(pos) AS last_offset, count(*) AS n, count(*) FILTER (disposition = 'applied') AS applied, count(*) FILTER (disposition LIKE 'quarantined%') AS quarantined FROM pos GROUP BY partition_no""")
def q48(spark, d):
    """Positions are gapless within a partition, so their ends follow from the count."""
    rows = V.dispositions(_rows(spark, d)).groupBy((F.col("item_id") % 8).alias("partition_no"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "applied").alias("applied"), F.count_if(F.col("disposition").startswith("quarantined")).alias("quarantined"))
    return n.withColumns({"first_offset": F.lit(0).cast("long"), "last_offset": F.col("n") - 1})
