"""Queries over queues, lineage chains, authorisation, audit and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.functions.text import line, ordered_hash, sha256
from eventfold.operators import access, outbox
from eventfold.plans.registry import query
from eventfold.sources.tables import table

STATUS = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'publishing' WHEN 'F' THEN 'published' ELSE 'quarantined' END"
QUEUE = f"q AS (SELECT o_orderkey, o_custkey, o_orderdate, {STATUS} AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS lease_expires_at, o_orderkey % 8 AS attempts FROM orders)"
NOW = "1998-01-01 00:00:00"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "publishing").when(F.col("o_orderstatus") == "F", "published").otherwise("quarantined")
    lease = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.make_dt_interval(F.col("o_orderkey") % 5))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", status.alias("status"), lease.alias("lease_expires_at"), (F.col("o_orderkey") % 8).alias("attempts"))


@query("q13_outbox_backlog", f"WITH {QUEUE} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'publishing') AS publishing, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'quarantined') AS quarantined, strftime(min(o_orderdate) FILTER (status IN ('pending', 'publishing')), '%Y-%m-%d') AS oldest_unpublished FROM q")
def q13(spark, d):
    return outbox.backlog(_queue(spark, d), "o_orderdate")


@query("q16_claim_due_100", f"WITH {QUEUE} SELECT o_orderkey, attempts + 1 AS attempts FROM q WHERE status IN ('pending', 'publishing') AND (lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '{NOW}') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def q16(spark, d):
    return outbox.claim(_queue(spark, d), F.to_timestamp_ntz(F.lit(NOW)), 100, "o_orderdate", "o_orderkey").select("o_orderkey", "attempts")


@query("q17_backoff_schedule", f"WITH {QUEUE} SELECT o_orderkey, attempts, CAST(least(60, power(2, greatest(attempts, 1) - 1)) AS BIGINT) AS backoff_seconds FROM q")
def q17(spark, d):
    return _queue(spark, d).select("o_orderkey", "attempts", outbox.backoff_seconds(F.col("attempts")).alias("backoff_seconds"))


@query("q18_trace_chain", """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(o_custkey, 0) AS o_custkey, coalesce(c_name, '') AS c_name, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q18(spark, d):
    """Outer joins along the chain; each key is unique on its right side, and Spark broadcasts the sides that its statistics show to be small."""
    t = lambda name, *c: table(spark, d, name).select(*c)
    places = t("nation", "n_nationkey", "n_name", "n_regionkey").join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    buyers = t("customer", "c_custkey", "c_name", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    chain = t("lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    chain = chain.join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return chain.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("o_custkey", F.lit(0).cast("long")).alias("o_custkey"), text("c_name"), text("n_name"), text("r_name"))


@query("q19_trace_supplier_chain", """SELECT l_partkey, l_suppkey, count(*) AS n_hops, max(coalesce(s_name, '')) AS s_name, max(coalesce(n_name, '')) AS n_name, max(coalesce(r_name, '')) AS r_name, max(coalesce(p_brand, '')) AS p_brand
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey""")
def q19(spark, d):
    """Grouped before the joins: each pair is traced once."""
    t = lambda name, *c: table(spark, d, name).select(*c)
    pairs = t("lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_hops"))
    out = pairs.join(t("supplier", "s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    out = out.join(t("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = out.join(t("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("l_partkey", "l_suppkey", "n_hops", *(F.coalesce(c, F.lit("")).alias(c) for c in ("s_name", "n_name", "r_name", "p_brand")))


HOPS = """hops AS (SELECT 'supplier' AS kind, s_suppkey % 4 AS tenant_no, s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS parent FROM supplier UNION ALL SELECT 'part', p_partkey % 4, p_partkey, CAST(p_size AS BIGINT) FROM part
UNION ALL SELECT 'order', o_orderkey % 4, o_orderkey, o_custkey FROM orders UNION ALL SELECT 'customer', c_custkey % 4, c_custkey, CAST(c_nationkey AS BIGINT) FROM customer)"""


def _hops(spark, d):
    kinds = (("supplier", "s_suppkey", "s_nationkey"), ("part", "p_partkey", "p_size"), ("order", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"))
    out = None
    for kind, key, parent in kinds:
        one = table(spark, d, f"{kind}s" if kind == "order" else kind).select(F.lit(kind).alias("kind"), (F.col(key) % 4).alias("tenant_no"), F.col(key).alias("id"), F.col(parent).cast("long").alias("parent"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q20_lineage_union_checksum", f"WITH {HOPS} SELECT tenant_no, sha256(string_agg(kind || chr(9) || tenant_no || chr(9) || id || chr(9) || parent || chr(10), '' ORDER BY kind, CAST(id AS VARCHAR), parent)) AS checksum FROM hops GROUP BY tenant_no")
def q20(spark, d):
    return ordered_hash(_hops(spark, d), ["tenant_no"], line("kind", "tenant_no", "id", "parent"), "kind", F.col("id").cast("string"), "parent")


@query("q20b_lineage_row_counts", f"WITH {HOPS} SELECT tenant_no, kind, count(*) AS n FROM hops GROUP BY ALL")
def q20b(spark, d):
    return _hops(spark, d).groupBy("tenant_no", "kind").agg(F.count("*").alias("n"))


@query("q21_one_to_one_first_wins", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) x WHERE n = 1")
def q21(spark, d):
    """The least struct of a key: partial aggregation leaves one row a key and task, where a window would shuffle all."""
    first = F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("w")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(first).select("l_partkey", "w.l_orderkey", "w.l_linenumber", "w.l_suppkey")


@query("q22_orphan_children", "SELECT 'line without order' AS problem, l_orderkey AS id, count(*) AS n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey UNION ALL SELECT 'order without line', o_orderkey, count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q22(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    orders = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.count("*").alias("n"))
    one = lambda a, b, text: a.join(b.select("id"), "id", "left_anti").select(F.lit(text).alias("problem"), "id", "n")
    return one(lines, orders, "line without order").unionByName(one(orders, lines, "order without line"))


ALLOW = ", ".join(f"('{t}', '{r}', '{s}', '{a}')" for t, r, s, a in access.MATRIX)


@query("q43_allow_matrix", f"""WITH allow(scope, role_id, resource, action) AS (VALUES {ALLOW}),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'runtime' WHEN c_custkey % 4 = 2 THEN 'tenant-2' ELSE 'tenant-1' END AS tenant_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'ops_reader' WHEN 'MACHINERY' THEN 'platform_operator' WHEN 'AUTOMOBILE' THEN 'release_observer' ELSE '' END AS role_id FROM customer)
SELECT c_custkey, scope, resource, action FROM a JOIN allow USING (role_id) WHERE tenant_id = scope""")
def q43(spark, d):
    tenant = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 4 == 1, "runtime").when(F.col("c_custkey") % 4 == 2, "tenant-2").otherwise("tenant-1")
    seg = F.col("c_mktsegment")
    role = F.when(seg == "BUILDING", "ops_reader").when(seg == "MACHINERY", "platform_operator").when(seg == "AUTOMOBILE", "release_observer").otherwise("")
    assigned = table(spark, d, "customer").select(F.col("c_custkey").alias("principal_id"), tenant.alias("tenant_id"), role.alias("role_id"))
    return access.allowed(spark, assigned).select(F.col("principal_id").alias("c_custkey"), F.col("tenant_id").alias("scope"), "resource", "action")


@query("q44_audit_timeline", "SELECT event_id, user_id % 4 AS tenant_no, 'principal-' || user_id AS principal_id, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS outcome, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at FROM events ORDER BY tenant_no, ts, event_id")
def q44(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 4).alias("tenant_no"), F.concat(F.lit("principal-"), F.col("user_id").cast("string")).alias("principal_id"),
        F.when(F.col("event_type") == "error", "deny").otherwise("allow").alias("outcome"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_at"), "ts",
    )
    return rows.orderBy("tenant_no", "ts", "event_id").drop("ts")


KINDS, OUTCOMES = ("view", "click", "purchase", "signup", "error", "retry"), ("ok", "slow", "failed")
COUNTED = f"""WITH k AS (SELECT unnest({list(KINDS)}) AS kind), o AS (SELECT unnest({list(OUTCOMES)}) AS outcome), c AS (
  SELECT event_type AS kind, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'slow' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY ALL)
SELECT kind, outcome, coalesce(n, 0) AS n FROM k CROSS JOIN o LEFT JOIN c USING (kind, outcome)"""


@query("q45_metrics_counters_zero_filled", COUNTED)
def q45(spark, d):
    """All label pairs are literals; a zero row of each joins the counts in one aggregation instead of a join."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "slow").otherwise("ok")
    seen = table(spark, d, "events").select(F.col("event_type").alias("kind"), outcome.alias("outcome"), F.lit(1).cast("long").alias("n"))
    zeros = spark.createDataFrame([(k, o, 0) for k in KINDS for o in OUTCOMES], "kind string, outcome string, n long")
    return seen.where(F.col("kind").isin(*KINDS)).unionByName(zeros).groupBy("kind", "outcome").agg(F.sum("n").alias("n"))


@query("q46_consumer_lag", """WITH p AS (SELECT user_id % 8 AS partition_no, count(*) AS high, count(*) FILTER (ts < TIMESTAMP '2024-01-25 00:00:00') AS done FROM events GROUP BY ALL)
SELECT CAST(sum(greatest(0, high - done)) AS BIGINT) AS lag, bool_and(high > 0) AS known FROM p""")
def q46(spark, d):
    done = F.count_if(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00")))
    parts = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("p")).agg(F.count("*").alias("high"), done.alias("done"))
    return parts.agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("high") - F.col("done"))).alias("lag"), F.bool_and(F.col("high") > 0).alias("known"))


@query("q47_view_reducer_previous_quantity", """WITH v AS (SELECT user_id AS item_id, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS quantity, lag(CAST(floor(value / 25) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, item_id, quantity, coalesce(previous, -1) AS previous FROM v WHERE previous IS NULL OR previous <> quantity""")
def q47(spark, d):
    """An update with the quantity that a view already shows makes no transition."""
    order = Window.partitionBy("item_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("item_id"), "ts", F.floor(F.col("value") / 25).cast("long").alias("quantity"))
    return rows.withColumn("previous", F.lag("quantity").over(order)).where("previous IS NULL OR previous <> quantity").select("event_id", "item_id", "quantity", F.coalesce("previous", F.lit(-1).cast("long")).alias("previous"))


@query("q50_poison_attempt_budget", """WITH a AS (SELECT event_id, 1 + event_id % 7 AS attempts FROM events WHERE event_type = 'error')
SELECT event_id, least(attempts, 5) AS attempt_count, CASE WHEN attempts >= 5 THEN 'quarantined' ELSE 'retrying' END AS quarantine_status, attempts >= 5 AS acknowledged FROM a""")
def q50(spark, d):
    n = 1 + F.col("event_id") % 7
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", F.least(n, F.lit(outbox.POISON_ATTEMPTS)).alias("attempt_count"), F.when(n >= outbox.POISON_ATTEMPTS, "quarantined").otherwise("retrying").alias("quarantine_status"), (n >= outbox.POISON_ATTEMPTS).alias("acknowledged"))


@query("q51_document_content_identity", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q51(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sha256(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


@query("q52_prometheus_text", f"""WITH m AS ({COUNTED}), r AS (SELECT 'events_total{{kind="' || kind || '",outcome="' || outcome || '"}} ' || n AS line FROM m UNION ALL SELECT '# TYPE events_total counter') SELECT line FROM r ORDER BY line""")
def q52(spark, d):
    rows = q45(spark, d).select(F.format_string('events_total{kind="%s",outcome="%s"} %d', "kind", "outcome", "n").alias("line"))
    return rows.unionByName(spark.createDataFrame([("# TYPE events_total counter",)], "line string")).orderBy("line")
