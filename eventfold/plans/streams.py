"""Queries that fold the delivered log, in a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.text import line, sha256
from eventfold.operators import fold as R
from eventfold.operators import versioned as V
from eventfold.operators.reads import checkpoint_probe
from eventfold.plans.processing import RAW_DISPOSITIONS, RAW_FAILURES, RAW_SQL, REPLAY_SQL, raw_log, replay_inputs, retained
from eventfold.plans.projection import WITH
from eventfold.plans.registry import query
from eventfold.sources.tables import scratch, table, written
from eventfold.streaming import raw as W
from eventfold.streaming.log import read_log
from eventfold.streaming.store import Feed, PredictionStore


def delivered(spark, d: str) -> DataFrame:
    """The records in order of arrival: all base events, then the repeated ones, then those with other content."""
    rows = V.log(spark, d).where(f"NOT ({V.DROPPED})")
    phases = [F.when(F.expr(test), F.struct(F.lit(phase).alias("phase"), F.lit(off).alias("off"))) for phase, test, off in ((0, "true", 0), (1, V.REPEATED, 0), (2, V.CONFLICT, 1))]
    rows = rows.select("*", F.explode(F.array_compact(F.array(*phases))).alias("x"))
    rows = rows.select("*", "x.phase", (F.col("after_qty") - F.col("x.off")).alias("after"), (F.col("dec") + F.col("x.off")).alias("asked"))
    tenant, item = F.concat(F.lit("tenant-"), F.col("tenant_no").cast("string")), F.col("item_id").cast("string")
    return rows.select(
        F.concat_ws("/", tenant, F.lit("inventory_item"), item).alias("group"), (F.col("phase") * 10**12 + F.col("version")).cast("long").alias("seq"), F.lit(None).cast("string").alias("log_key"), F.col("event_id").cast("string").alias("event_id"),
        tenant.alias("tenant_id"), F.lit("inventory_item").alias("aggregate_type"), item.alias("aggregate_id"), "version", F.col("before_qty").alias("before"), "after",
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("order_id"), sha256(line(item, "version", "asked", "after")).alias("content_hash"), "phase",
    )


@query("q03b_fold_dispositions", WITH + "SELECT CAST(event_id AS VARCHAR) AS event_id, disposition FROM disp")
def q03b(spark, d):
    return R.inbox(R.fold(delivered(spark, d))).select("event_id", "disposition")


PROJECTION = WITH + "SELECT 'tenant-' || tenant_no AS tenant_id, CAST(item_id AS VARCHAR) AS item_id, quantity_on_hand, aggregate_version FROM proj"


@query("q01b_fold_projection", PROJECTION)
def q01b(spark, d):
    return R.inventory(R.fold(delivered(spark, d)))


@query("q49_stream_equals_batch_projection", PROJECTION)
def q49(spark, d):
    """The records written as a log of three phases, streamed through the stateful fold some files at a time."""
    W.with_rocksdb(spark)
    top, rows = scratch(spark, "stream"), written(delivered(spark, d), "delivered")
    for phase in range(3):
        W.placed(rows.where(F.col("phase") == phase)).repartition(W.FILES, "group").write.mode("append").parquet(f"{top}/log")
    log = read_log(spark, f"{top}/log", W.INPUT, files=W.FILES)
    return R.inventory(W.run(W.results(log), W.RESULTS, f"{top}/changes", f"{top}/checkpoint"))


def streamed(spark, d: str, fails: str | None = None) -> DataFrame:
    """The raw log through the stateful stream, in two runs: it stops after the first deliveries and is started again, from
    its checkpoint, for the repeated ones. ``fails``: for which records a handler fails."""
    W.with_rocksdb(spark)
    top, rows = scratch(spark, "raw-stream"), written(raw_log(spark, d), "raw-log")
    arrivals = F.when(F.expr(fails), F.lit("handler")) if fails else None
    for phase, test in enumerate(("arrival < 1000000000000", "arrival >= 1000000000000")):
        rows.where(test).repartition(2 * W.FILES if phase == 0 else W.FILES, "key").write.mode("append").parquet(f"{top}/log")
        log = read_log(spark, f"{top}/log", rows.schema, files=W.FILES)
        found = W.run(W.results(W.prepared(log, F.col("arrival"), arrivals)), W.RESULTS, f"{top}/results", f"{top}/checkpoint")
    return found


@query("q53c_raw_stream_dispositions", RAW_DISPOSITIONS)
def q53c(spark, d):
    return R.inbox(streamed(spark, d).where("disposition IS NOT NULL")).select("event_id", "disposition")


@query("q54c_raw_stream_failures", RAW_FAILURES)
def q54c(spark, d):
    rows = W.failures(streamed(spark, d))
    return rows.select(F.col("offset").alias("position"), "failure_category", "diagnostic_code", "attempt_count", "event_id", "version", "quarantine_status")


@query("q02c_stream_commits", RAW_SQL + """ SELECT CAST(item_id % 8 AS INTEGER) AS partition, coalesce(min(event_id) FILTER (event_id % 61 = 0 AND kind IN ('ok', 'key')), max(event_id) + 1) AS committed,
  count(*) FILTER (event_id % 61 = 0 AND kind IN ('ok', 'key')) AS open FROM raw GROUP BY ALL""")
def q02c(spark, d):
    """The commit frontier of the stream where a handler fails on every 61st record."""
    top = scratch(spark, "commits")
    found = streamed(spark, d, "offset % 61 = 0")
    path = found.inputFiles()[0].rsplit("/", 1)[0]
    told = W.run(W.commits(read_log(spark, path, W.RESULTS, files=8 * W.FILES)), W.COMMITS, f"{top}/commits", f"{top}/checkpoint")
    return W.committed(told).select("partition", "committed", "open")


@query("q59c_replay_from_initial_state", REPLAY_SQL + " SELECT CAST(event_id AS VARCHAR) AS event_id, disposition FROM r")
def q59c(spark, d):
    """The retained history as a stream that starts from the stored inbox and projection."""
    W.with_rocksdb(spark)
    top, (state, history) = scratch(spark, "replay-stream"), replay_inputs(spark, d)
    W.placed(history).repartition(W.FILES, "group").write.parquet(f"{top}/log")
    rows = W.results(read_log(spark, f"{top}/log", W.INPUT, files=W.FILES), state)
    return W.run(rows, W.RESULTS, f"{top}/results", f"{top}/checkpoint").where("offset IS NOT NULL").select("event_id", "disposition")


BATCHED = "SELECT event_id % 2000 AS prediction_id, 'tenant-' || (event_id % 4) AS tenant_id, event_id % 7 AS content, (event_id // 2000) % 4 AS batch FROM events"


@query("q41c_prediction_store", f"""WITH p AS ({BATCHED}), f AS (SELECT prediction_id, min(batch) AS batch FROM p GROUP BY prediction_id), s AS (SELECT prediction_id, batch, min(content) AS content FROM p JOIN f USING (prediction_id, batch) GROUP BY ALL),
e AS (SELECT prediction_id, p.batch, min(p.content) AS least, count(DISTINCT p.content) AS n FROM p GROUP BY ALL)
SELECT prediction_id, e.batch, CASE WHEN e.batch = s.batch THEN 'append' WHEN n = 1 AND least = s.content THEN 'keep' ELSE 'conflict' END AS effect, s.content AS stored FROM e JOIN (SELECT prediction_id, batch, content FROM s) s USING (prediction_id)""")
def q41c(spark, d):
    """Predictions in four batches, of which the second comes twice, also after the last: each id keeps its first content."""
    event = F.col("event_id")
    rows = table(spark, d, "events").select((event % 2000).alias("prediction_id"), F.concat(F.lit("tenant-"), (event % 4).cast("string")).alias("tenant_id"), (event % 7).alias("content"), F.floor(event / 2000).cast("long").alias("k"))
    rows = written(rows, "predictions")
    store = PredictionStore(spark, scratch(spark, "store"), "prediction_id long, tenant_id string, content long", buckets=8)
    for batch in (0, 1, 1, 2, 3, 1):
        store.insert(rows.where(F.col("k") % 4 == batch), batch)
    stored = store.rows().select("prediction_id", F.col("content").alias("stored"))
    return store.effects().join(stored, "prediction_id").select("prediction_id", "batch", "effect", "stored")


@query("q16c_change_feed", "SELECT event_id, (event_id // 500) % 3 AS batch FROM events WHERE user_id % 4 = 1 AND (event_id // 500) % 3 > 0")
def q16c(spark, d):
    """A tenant's changes behind a cursor at the first batch; the second batch is delivered twice."""
    event = F.col("event_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), "event_id", (F.floor(event / 500) % 3).alias("k"))
    rows = written(rows, "changes")
    feed = Feed(spark, scratch(spark, "feed"), "event_id long")
    for batch in (0, 1, 1, 2):
        feed.publish("projection", rows.where(F.col("k") == batch).drop("k"), batch)
    return feed.after("tenant-1", {"projection": 0}).select("event_id", "batch")


@query("q55b_checkpoint_probe", WITH + """ SELECT 'tenant-' || log.tenant_no AS tenant_id, CAST(log.event_id AS VARCHAR) AS event_id, CASE WHEN log.event_id % 7 = 0 THEN 'quarantined' ELSE 'published' END AS outbox, disp.disposition AS inbox, CASE WHEN log.event_type = 'error' THEN 'quarantined' END AS failure,
  CASE WHEN proj.item_id IS NOT NULL THEN 'last' END AS projection, CAST(1 + (disp.disposition IS NOT NULL)::INT + (log.event_type = 'error')::INT + (proj.item_id IS NOT NULL)::INT AS BIGINT) AS n_stores
  FROM log LEFT JOIN disp USING (event_id) LEFT JOIN proj ON proj.item_id = log.item_id AND proj.aggregate_version = log.version""")
def q55b(spark, d):
    outbox, inbox = retained(spark, d)
    rows = V.log(spark, d)
    own = [F.concat(F.lit("tenant-"), F.col("tenant_no").cast("string")).alias("tenant_id"), F.col("event_id").cast("string").alias("event_id")]
    last = V.projection(V.with_first_missing(rows)).select("item_id", F.col("aggregate_version").alias("version"))
    return checkpoint_probe({
        "outbox": outbox.select("tenant_id", "event_id", F.col("status").alias("state")), "inbox": inbox.select("tenant_id", "event_id", F.col("disposition").alias("state")),
        "failure": rows.where("event_type = 'error'").select(*own, F.lit("quarantined").alias("state")), "projection": rows.join(last, ["item_id", "version"], "left_semi").select(*own, F.lit("last").alias("state")),
    })
