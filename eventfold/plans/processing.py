"""Queries over raw records: parsing, failures, the forecast source at a cutoff, replay, release and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.functions import canon
from eventfold.functions.text import line, sha256
from eventfold.operators import artifacts as Z
from eventfold.operators import commands as K
from eventfold.operators import fold as R
from eventfold.operators import lineage as L
from eventfold.operators import process as N
from eventfold.operators import reads as D
from eventfold.operators import source as S
from eventfold.operators import validation as C
from eventfold.operators import versioned as V
from eventfold.plans.forecast import DATASET_SQL, PROTOCOL, SPLITS, daily, examples
from eventfold.plans.registry import query
from eventfold.sources.tables import table, written

LOG = "WITH " + V.LOG_SQL
CUTOFF = "2024-01-20 00:00:00"
TARGET = "stockout_within_7_days"
UNKNOWN, FAMILY, BROKEN, MISKEYED = 41, 43, 59, 47  # every so many events: an unknown field, another family, no JSON, a wrong key


def _uuid(number):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def raw_log(spark: SparkSession, d: str) -> DataFrame:
    """topic, partition, offset, key, value and arrival: the events as JSON bytes, some outside the contract, every 20th twice."""
    rows = V.log(spark, d).where(f"NOT ({V.DROPPED})")
    nth = lambda n: F.col("event_id") % n == 0
    item, at = F.concat(F.lit("item-"), F.col("item_id").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tenant = _uuid(F.col("tenant_no"))
    payload = F.struct(_uuid(F.col("event_id")).alias("order_id"), item.alias("item_id"), F.col("dec").alias("quantity_decremented"), F.col("before_qty").alias("quantity_before"), F.col("after_qty").alias("quantity_after"))
    members = {
        "event_id": _uuid(F.col("event_id")), "tenant_id": tenant, "event_type": F.when(nth(FAMILY), "inventory.unknown").otherwise("inventory.quantity_decremented"), "event_schema_version": F.lit(1), "aggregate_type": F.lit("inventory_item"),
        "aggregate_id": item, "aggregate_version": F.col("version"), "occurred_at": at, "recorded_at": at, "producer": F.lit(canon.PRODUCER), "correlation_id": _uuid(F.lit(7)), "causation_id": F.lit(None).cast("string"),
        "trace_id": F.lit("trace"), "payload": payload, "extra": F.when(nth(UNKNOWN), 1),
    }
    text = F.to_json(F.struct(*(c.alias(n) for n, c in members.items())), {"ignoreNullFields": "true"})
    text = F.regexp_replace(text, '"trace_id"', '"causation_id":null,"trace_id"')
    value = F.when(nth(BROKEN), "{").otherwise(text).cast("binary")
    key = F.concat_ws("/", tenant, F.lit("inventory_item"), F.when(nth(MISKEYED), "other").otherwise(item)).cast("binary")
    rows = rows.select(F.lit("events").alias("topic"), (F.col("item_id") % 8).cast("int").alias("partition"), F.col("event_id").alias("offset"), key.alias("key"), value.alias("value"), "version")
    arrivals = F.array_compact(F.array(F.col("version"), F.when(F.col("offset") % 20 == 0, F.lit(10**12) + F.col("version"))))
    return rows.withColumn("arrival", F.explode(arrivals)).drop("version")


RAW_SQL = LOG + f""", k AS (SELECT *, CASE WHEN event_id % {BROKEN} = 0 THEN 'broken' WHEN event_id % {UNKNOWN} = 0 THEN 'unknown' WHEN event_id % {FAMILY} = 0 THEN 'family' WHEN event_id % {MISKEYED} = 0 THEN 'key' ELSE 'ok' END AS kind FROM log),
hole AS (SELECT item_id, min(version) AS h FROM k WHERE event_id % 101 = 0 OR kind <> 'ok' GROUP BY item_id),
raw AS (SELECT k.*, hole.h, '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id FROM k LEFT JOIN hole USING (item_id) WHERE event_id % 101 <> 0)"""


RAW_DISPOSITIONS = RAW_SQL + """ SELECT id AS event_id, CASE WHEN kind = 'key' THEN 'quarantined_mismatch' WHEN version > h THEN 'quarantined_gap' WHEN event_id % 20 = 0 THEN 'duplicate_noop' ELSE 'applied' END AS disposition FROM raw WHERE kind IN ('ok', 'key')"""


@query("q53_raw_log_dispositions", RAW_DISPOSITIONS)
def q53(spark, d):
    _, changes = N.process(raw_log(spark, d), F.col("arrival"))
    return R.inbox(changes).select("event_id", "disposition")


@query("q53b_raw_log_projection", RAW_SQL + """ SELECT item_id AS item_no, min_by(after_qty, -version) AS quantity_on_hand, max(version) AS aggregate_version FROM raw WHERE kind = 'ok' AND (h IS NULL OR version < h) GROUP BY item_id""")
def q53b(spark, d):
    _, changes = N.process(raw_log(spark, d), F.col("arrival"))
    return R.inventory(changes).select(F.expr("cast(substring(item_id, 6) AS BIGINT)").alias("item_no"), "quantity_on_hand", "aggregate_version")


RAW_FAILURES = RAW_SQL + """ SELECT event_id AS position, CASE WHEN kind = 'family' THEN 'unsupported' ELSE 'malformed' END AS failure_category, CASE kind WHEN 'broken' THEN 'not JSON' WHEN 'unknown' THEN 'envelope: unknown extra' ELSE 'event type or schema version' END AS diagnostic_code,
  CAST(CASE WHEN event_id % 20 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempt_count, CASE WHEN kind <> 'broken' THEN id END AS event_id, CASE WHEN kind <> 'broken' THEN version END AS version, 'quarantined' AS quarantine_status FROM raw WHERE kind IN ('broken', 'unknown', 'family')"""


@query("q54_failure_rows", RAW_FAILURES)
def q54(spark, d):
    parsed = canon.parse_log(raw_log(spark, d), without=("value", "canonical"))
    rows = N.failure_rows(N.parse_failures(parsed, F.col("arrival")))
    return rows.select(F.col("offset").alias("position"), "failure_category", "diagnostic_code", "attempt_count", "event_id", "version", "quarantine_status")


@query("q54b_contract_rules", RAW_SQL + """ SELECT coalesce(rule, 'valid') AS rule, count(*) AS n FROM (SELECT CASE kind WHEN 'broken' THEN 'not JSON' WHEN 'unknown' THEN 'envelope: unknown extra' WHEN 'family' THEN 'event type or schema version' END AS rule FROM raw UNION ALL
  SELECT CASE kind WHEN 'broken' THEN 'not JSON' WHEN 'unknown' THEN 'envelope: unknown extra' WHEN 'family' THEN 'event type or schema version' END FROM raw WHERE event_id % 20 = 0) x GROUP BY ALL""")
def q54b(spark, d):
    parsed = canon.parse_log(raw_log(spark, d).select("value"), without=[c.split()[0] for c in ("value", *canon.PARSED.split(", ")) if c != "rule string"])
    return parsed.groupBy(F.coalesce("rule", F.lit("valid")).alias("rule")).agg(F.count("*").alias("n"))


@query("q50b_poison_failure_rows", """SELECT user_id AS position, CAST(count(*) AS BIGINT) AS attempt_count, CASE WHEN count(*) >= 5 THEN 'quarantined' ELSE 'retrying' END AS quarantine_status, count(*) >= 5 AS acknowledged,
  'code-' || max_by(event_id % 5, struct_pack(a := ts, b := event_id)) AS diagnostic_code FROM events WHERE event_type = 'error' GROUP BY user_id""")
def q50b(spark, d):
    """Error events as attempts of a handler at their user's position."""
    nothing = F.lit(None).cast("string")
    rows = table(spark, d, "events").where("event_type = 'error'").select(
        F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("user_id").alias("offset"), F.struct("ts", F.col("event_id").alias("no")).alias("attempt"), F.lit("poison").alias("failure_category"),
        F.concat(F.lit("code-"), (F.col("event_id") % 5).cast("string")).alias("diagnostic_code"), nothing.alias("received_hash"), F.col("event_id").cast("string").alias("event_id"), nothing.alias("tenant_id"), nothing.alias("event_type"), F.lit(None).cast("long").alias("schema_version"), nothing.alias("aggregate_type"),
        nothing.alias("aggregate_id"), F.lit(None).cast("long").alias("version"), F.lit("retrying").alias("status"),
    )
    return N.failure_rows(rows).select(F.col("offset").alias("position"), "attempt_count", "quarantine_status", "acknowledged", "diagnostic_code")


@query("q02b_committed_offsets", """WITH p AS (SELECT user_id % 8 AS partition, event_id, event_type <> 'error' AS ok FROM events) SELECT partition, coalesce(min(event_id) FILTER (NOT ok), max(event_id) + 1) AS committed, count(*) FILTER (NOT ok) AS open FROM p GROUP BY partition""")
def q02b(spark, d):
    return N.acknowledged(table(spark, d, "events").select((F.col("user_id") % 8).alias("partition"), F.col("event_id").alias("offset"), (F.col("event_type") != "error").alias("acknowledged")))


def retained(spark, d) -> tuple[DataFrame, DataFrame]:
    """The outbox of all events, and the inbox of those that were delivered."""
    rows = V.log(spark, d)
    tenant, item, event = F.concat(F.lit("tenant-"), F.col("tenant_no").cast("string")), F.col("item_id").cast("string"), F.col("event_id").cast("string")
    own = [event.alias("event_id"), tenant.alias("tenant_id"), item.alias("item_id"), "version", sha256(line(item, "version", "dec")).alias("content_hash")]
    outbox = rows.select(*own, F.when(F.col("event_id") % 7 == 0, "quarantined").otherwise("published").alias("status"), F.col("ts").alias("recorded_at"), F.col("before_qty").alias("before"), "dec", F.col("after_qty").alias("after"))
    inbox = V.dispositions(V.with_first_missing(rows)).select(*own, "disposition")
    return outbox, inbox


SOURCE_SQL = LOG + f""", o AS (SELECT log.*, CASE WHEN log.event_id % 7 = 0 THEN 'quarantined' ELSE 'published' END AS status, disp.disposition FROM log LEFT JOIN disp USING (event_id) WHERE log.ts <= TIMESTAMP '{CUTOFF}'),
acc AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY version, event_id) AS rn FROM o WHERE disposition IN ('applied', 'duplicate_noop')),
pre AS (SELECT item_id, count(*) FILTER (version = rn) + 1 AS expected FROM acc GROUP BY item_id),
reason AS (
  SELECT tenant_no, CASE WHEN disposition IS NULL AND status = 'published' THEN 'stale:inventory event not applied ' || event_id WHEN disposition IS NULL THEN 'incomplete:inventory event has no platform disposition ' || event_id
    ELSE 'incomplete:inventory event disposition ' || disposition || ' ' || event_id END AS reason FROM o WHERE disposition IS NULL OR disposition NOT IN ('applied', 'duplicate_noop')
  UNION SELECT tenant_no, 'incomplete:aggregate version gap ' || item_id || ' expected ' || expected || ' received ' || version FROM acc JOIN pre USING (item_id) WHERE version > expected
  UNION SELECT tenant_no, 'incomplete:inventory inbox event missing retained outbox ' || event_id FROM o WHERE disposition IS NOT NULL AND disposition NOT IN ('applied', 'duplicate_noop')
  UNION SELECT tenant_no, 'incomplete:inventory inbox disposition quarantined_gap ' || event_id FROM o WHERE disposition = 'quarantined_gap')"""


@query("q55_forecast_source_reasons", SOURCE_SQL + " SELECT 'tenant-' || tenant_no AS tenant_id, reason FROM reason")
def q55(spark, d):
    return S.source_reasons(*retained(spark, d), F.lit(CUTOFF).cast("timestamp"))


@query("q56_forecast_observations", SOURCE_SQL + " SELECT CAST(item_id AS VARCHAR) AS item_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS as_of_date, max_by(after_qty, version) AS quantity_on_hand FROM acc WHERE version = rn GROUP BY ALL")
def q56(spark, d):
    outbox, inbox = retained(spark, d)
    accepted = S.classified(S.until(outbox, F.lit(CUTOFF).cast("timestamp")), inbox).where("reason IS NULL")
    return S.observations(S.replayed(accepted)).select("item_id", F.col("as_of_date").cast("string").alias("as_of_date"), "quantity_on_hand")


@query("q57_source_boundary", SOURCE_SQL + """ SELECT 'tenant-' || tenant_no AS tenant_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, min_by(CAST(event_id AS VARCHAR), struct_pack(a := CAST(item_id AS VARCHAR), b := version, c := CAST(event_id AS VARCHAR))) AS event_id
  FROM acc JOIN (SELECT tenant_no, max(ts) AS ts FROM acc GROUP BY tenant_no) m USING (tenant_no, ts) GROUP BY ALL""")
def q57(spark, d):
    """Over accepted events only: what is retained, but was not applied, does not move the boundary."""
    outbox, inbox = retained(spark, d)
    rows = S.boundary(S.classified(S.until(outbox, F.lit(CUTOFF).cast("timestamp")), inbox).where("reason IS NULL"))
    return rows.select("tenant_id", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_at"), "event_id")


@query("q57b_forecast_source", SOURCE_SQL + """, last AS (SELECT tenant_no, item_id, max_by(after_qty, version) AS q, max(version) AS v FROM acc WHERE version = rn GROUP BY ALL),
pairs AS (SELECT coalesce(p.tenant_no, l.tenant_no) AS tenant_no, coalesce(p.item_id, l.item_id) AS item_id, p.quantity_on_hand AS pq, p.aggregate_version AS pv, l.q, l.v FROM proj p FULL JOIN last l ON p.tenant_no = l.tenant_no AND p.item_id = l.item_id),
every AS (SELECT tenant_no, reason FROM reason UNION SELECT tenant_no, 'incomplete:projection item missing retained history ' || item_id FROM pairs WHERE v IS NULL
  UNION SELECT tenant_no, 'incomplete:projection quantity differs from replay ' || item_id FROM pairs WHERE pv IS NOT NULL AND v IS NOT NULL AND pq <> q
  UNION SELECT tenant_no, 'incomplete:projection version differs from replay ' || item_id FROM pairs WHERE pv IS NOT NULL AND v IS NOT NULL AND pv <> v UNION SELECT tenant_no, 'incomplete:replayed item missing projection ' || item_id FROM pairs WHERE pv IS NULL),
days AS (SELECT tenant_no, count(*) AS n FROM (SELECT DISTINCT tenant_no, item_id, CAST(ts AS DATE) FROM acc WHERE version = rn) x GROUP BY tenant_no),
hist AS (SELECT tenant_no, count(*) AS n, max(ts) AS ts, sha256(string_agg('tenant-' || tenant_no || chr(9) || item_id || chr(9) || version || chr(9) || event_id || chr(9) || sha256(item_id || chr(9) || version || chr(9) || dec || chr(10)) || chr(9) || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(10), '' ORDER BY CAST(item_id AS VARCHAR), version, CAST(event_id AS VARCHAR))) AS h FROM acc GROUP BY tenant_no),
sums AS (SELECT tenant_no, sha256(string_agg('tenant-' || tenant_no || chr(9) || item_id || chr(9) || quantity_on_hand || chr(9) || aggregate_version || chr(10), '' ORDER BY CAST(item_id AS VARCHAR))) AS p FROM proj GROUP BY tenant_no)
SELECT 'tenant-' || t.tenant_no AS tenant_id, CASE WHEN n_reasons = 0 THEN 'complete' WHEN other = 0 THEN 'stale' ELSE 'incomplete' END AS status, reasons, coalesce(hist.n, 0) AS applied_event_count, coalesce(days.n, 0) AS n_observations, strftime(hist.ts, '%Y-%m-%d %H:%M:%S') AS max_recorded_at,
  CAST(CAST(hist.ts AS DATE) AS VARCHAR) AS source_cutoff_date, hist.h AS history_checksum, sums.p AS projection_checksum
FROM (SELECT DISTINCT tenant_no FROM log) t LEFT JOIN hist USING (tenant_no) LEFT JOIN days USING (tenant_no) LEFT JOIN sums USING (tenant_no)
LEFT JOIN (SELECT tenant_no, count(*) AS n_reasons, count(*) FILTER (reason NOT LIKE 'stale:%') AS other, string_agg(reason, chr(10) ORDER BY reason) AS reasons FROM every GROUP BY tenant_no) r USING (tenant_no)""")
def q57b(spark, d):
    """Status, reasons, boundary and checksums of each tenant's source, the projection of all deliveries beside it."""
    rows = V.projection(V.with_first_missing(V.log(spark, d)))
    projection = rows.select(F.concat(F.lit("tenant-"), F.col("tenant_no").cast("string")).alias("tenant_id"), F.col("item_id").cast("string").alias("item_id"), "quantity_on_hand", "aggregate_version")
    found = S.forecast_source(*(written(x, "retained") for x in retained(spark, d)), written(projection, "projection"), F.lit(CUTOFF).cast("timestamp"))
    return found.select(
        "tenant_id", "status", F.array_join("status_reasons", "\n").alias("reasons"), "applied_event_count", "n_observations", F.date_format("max_recorded_at", "yyyy-MM-dd HH:mm:ss").alias("max_recorded_at"),
        F.col("source_cutoff_date").cast("string").alias("source_cutoff_date"), "history_checksum", "projection_checksum",
    )


@query("q58_history_offsets", LOG + " SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(row_number() OVER (PARTITION BY tenant_no ORDER BY CAST(item_id AS VARCHAR), version, ts, CAST(event_id AS VARCHAR)) AS BIGINT) AS \"offset\" FROM log")
def q58(spark, d):
    """Offsets run over a whole tenant, not over each item."""
    return S.history_offsets(retained(spark, d)[0]).select("event_id", "offset")


REPLAY_SQL = LOG + """, b AS (SELECT item_id, min(version) AS b FROM j WHERE event_id % 33 = 0 AND event_id % 101 <> 0 AND version > m GROUP BY item_id),
r AS (SELECT j.tenant_no, j.event_id, CASE WHEN event_id % 33 = 0 AND event_id % 101 <> 0 THEN 'quarantined_conflict' WHEN version > b THEN 'quarantined_gap' WHEN event_id % 101 = 0 THEN 'applied' ELSE 'duplicate_noop' END AS disposition FROM j LEFT JOIN b USING (item_id))"""


def replay_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """What is stored, inbox rows and projections, and the retained history that is replayed onto it."""
    rows = V.with_first_missing(V.log(spark, d)).withColumn("_last", F.max(F.expr("CASE WHEN m IS NULL OR version < m THEN version END")).over(Window.partitionBy("item_id")))
    rows = written(rows.drop("event_type", "ts"), "replay-log")
    tenant, item = F.concat(F.lit("tenant-"), F.col("tenant_no").cast("string")), F.col("item_id").cast("string")
    no = F.lit(None).cast("string")

    def record(df, *more):
        own = (F.concat_ws("/", tenant, F.lit("inventory_item"), item).alias("group"), F.col("version").alias("seq"), no.alias("log_key"), F.col("event_id").cast("string").alias("event_id"), tenant.alias("tenant_id"), F.lit("inventory_item").alias("aggregate_type"))
        return df.select(*own, item.alias("aggregate_id"), "version", F.col("before_qty").alias("before"), F.col("after_qty").alias("after"), no.alias("parent_id"), no.alias("order_id"), sha256(line("event_id", "dec")).alias("content_hash"), *more)

    conflict = F.expr(V.CONFLICT)  # the inbox keeps the first content's hash, the retained record has it too
    inbox = record(V.dispositions(rows), F.when(conflict, "quarantined_conflict").otherwise(F.col("disposition")).alias("disposition"))
    last = record(rows.where("version = _last"), F.lit("projection").alias("disposition"))
    return inbox.unionByName(last), record(rows)


def _replayed_onto(spark, d) -> DataFrame:
    return S.replay_onto(*replay_inputs(spark, d))


@query("q59_replay_without_reset", REPLAY_SQL + " SELECT CAST(event_id AS VARCHAR) AS event_id, disposition FROM r")
def q59(spark, d):
    return _replayed_onto(spark, d).select("event_id", "disposition")


@query("q59b_replay_counts", REPLAY_SQL + """ SELECT 'tenant-' || tenant_no AS tenant_id, count(*) FILTER (disposition = 'applied') AS applied, count(*) FILTER (disposition = 'duplicate_noop') AS duplicate_noop, count(*) FILTER (disposition = 'quarantined_conflict') AS quarantined,
  count(*) FILTER (disposition = 'quarantined_gap') AS gaps, count(*) AS n, CASE WHEN count(*) FILTER (disposition LIKE 'quarantined%') = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM r GROUP BY tenant_no""")
def q59b(spark, d):
    return S.replay_counts(_replayed_onto(spark, d).withColumn("tenant_id", F.substring_index("group", "/", 1)), "tenant_id")


@query("q60_release_outcomes", LOG + """ SELECT CAST(log.event_id AS VARCHAR) AS event_id, CASE WHEN disposition LIKE 'quarantined%' THEN 'not_releasable' WHEN log.event_id % 7 = 0 THEN 'pending' WHEN log.event_type = 'error' THEN 'redrive' ELSE 'not_found' END AS outcome FROM log LEFT JOIN disp USING (event_id)""")
def q60(spark, d):
    outbox, inbox = retained(spark, d)
    failed = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), F.col("event_id").cast("string").alias("event_id"), F.lit("quarantined").alias("quarantine_status"))
    return S.release_outcomes(outbox.select("tenant_id", "event_id"), inbox, outbox, failed).select("event_id", "outcome")


BAD_SQL = f"WITH {DATASET_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY as_of_date) AS k, CAST(item_id AS BIGINT) AS i FROM ex)"


def _numbered(spark, d) -> DataFrame:
    rows = examples(spark, d)
    return written(rows.withColumns({"k": F.row_number().over(Window.partitionBy("item_id").orderBy("as_of_date")), "i": F.col("item_id").cast("long")}), "numbered")


@query("q61_baseline_input_problems", BAD_SQL + """ SELECT row_id, CASE WHEN (i + k) % 29 = 0 THEN 'split' WHEN (i + k) % 31 = 0 THEN 'label' WHEN (i + k) % 37 = 0 THEN 'source cutoff' WHEN (i + k) % 41 = 0 THEN 'quantity' END AS problem FROM n
  WHERE (i + k) % 29 = 0 OR (i + k) % 31 = 0 OR (i + k) % 37 = 0 OR (i + k) % 41 = 0""")
def q61(spark, d):
    nth = lambda n: (F.col("i") + F.col("k")) % n == 0
    rows = _numbered(spark, d).withColumns({
        "split": F.when(nth(29), "later").otherwise(F.col("split")), "label": F.when(nth(31), 2).otherwise(F.col("label")), "quantity_on_hand": F.when(nth(41), -1).otherwise(F.col("quantity_on_hand")),
        "source_cutoff_date": F.when(nth(37), F.date_add("as_of_date", 1)).otherwise(F.col("source_cutoff_date")),
    })
    return C.input_problems(rows, PROTOCOL)


@query("q62_split_problems", BAD_SQL + """, s AS (SELECT as_of_date, CASE WHEN date_diff('day', DATE '2024-01-01', as_of_date) = 3 AND i % 2 = 0 THEN 'test' WHEN date_diff('day', DATE '2024-01-01', as_of_date) = 20 THEN 'train' ELSE split END AS split FROM n),
  g AS (SELECT as_of_date, count(DISTINCT split) AS n, max(CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) AS rank FROM s GROUP BY as_of_date), l AS (SELECT *, lag(rank) OVER (ORDER BY as_of_date) AS before FROM g)
  SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, CASE WHEN n > 1 THEN 'several splits' ELSE 'split before an earlier one' END AS problem FROM l WHERE n > 1 OR before > rank""")
def q62(spark, d):
    day = F.datediff("as_of_date", F.lit("2024-01-01").cast("date"))
    split = F.when((day == 3) & (F.col("item_id").cast("long") % 2 == 0), "test").when(day == 20, "train").otherwise(F.col("split"))
    return C.split_problems(examples(spark, d).withColumn("split", split)).select(F.col("as_of_date").cast("string").alias("as_of_date"), "problem")


def _artifact(rows: DataFrame) -> DataFrame:
    nth = lambda n: (F.col("i") + F.col("k")) % n == 0
    abstained = nth(11)
    return rows.select(
        "row_id", F.when(nth(13), "other").otherwise(TARGET).alias("target"), F.lit(7).alias("horizon_days"), F.when(nth(17), F.date_add("as_of_date", 1)).otherwise(F.col("as_of_date")).alias("source_cutoff_date"), F.when(abstained, "abstained").otherwise("predicted").alias("status"),
        F.when(nth(19), 1.5).when(abstained, None).otherwise(0.5).alias("score"), F.when(~abstained, F.when(nth(23), 0.6).otherwise(0.25)).alias("lower"), F.when(~abstained, 0.75).alias("upper"), F.when(abstained, "insufficient_support").otherwise("").alias("abstention_reason"), "item_id", "k", "i",
    )


@query("q63_artifact_problems", BAD_SQL + f""", a AS (SELECT row_id, i + k AS z, (i + k) % 43 = 0 AS omitted, (i + k) % 47 = 0 AS twice FROM n)
  SELECT row_id, CASE WHEN omitted THEN 'omitted row' WHEN twice THEN 'duplicate row' WHEN z % 13 = 0 THEN 'target or horizon' WHEN z % 17 = 0 THEN 'cutoff' WHEN z % 19 = 0 AND z % 11 = 0 THEN 'abstained state' WHEN z % 19 = 0 THEN 'score' ELSE 'uncertainty bounds' END AS problem
  FROM a WHERE omitted OR twice OR z % 13 = 0 OR z % 17 = 0 OR z % 19 = 0 OR (z % 23 = 0 AND z % 11 <> 0)""")
def q63(spark, d):
    rows = _numbered(spark, d)
    made = _artifact(rows).where("(i + k) % 43 <> 0")
    return C.artifact_problems(made.unionByName(made.where("(i + k) % 47 = 0")), rows, TARGET)


@query("q64_learned_response", BAD_SQL + """ SELECT row_id, CASE WHEN (i + k) % 43 = 0 OR (i + k) % 17 = 0 OR (i + k) % 11 = 0 THEN 'abstained' ELSE 'predicted' END AS status,
  CASE WHEN (i + k) % 43 = 0 OR (i + k) % 17 = 0 THEN 'unsupported_input' WHEN (i + k) % 11 = 0 THEN 'insufficient_support' ELSE '' END AS abstention_reason FROM n""")
def q64(spark, d):
    rows = _numbered(spark, d)
    asked = rows.select("row_id", "item_id", F.col("as_of_date").alias("observation_date"))
    return C.learned_response(asked, _artifact(rows).where("(i + k) % 43 <> 0")).select("row_id", "status", "abstention_reason")


@query("q65_runtime_selection", """WITH e AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'baseline' WHEN 2 THEN 'other' END AS outcome, c_custkey % 3 = 0 AS eligible, c_custkey % 6 = 0 AS beats FROM customer)
SELECT c_custkey, CASE WHEN outcome IS NULL THEN 'no test outcome' WHEN outcome = 'other' THEN 'no predictor' WHEN outcome = 'candidate' AND NOT (eligible AND beats) THEN 'candidate is not eligible' WHEN outcome = 'baseline' AND (eligible OR beats) THEN 'baseline is contradictory' END AS problem,
  CASE WHEN outcome = 'candidate' AND eligible AND beats THEN 'v1' WHEN outcome = 'baseline' AND NOT (eligible OR beats) THEN 'moving_average' END AS model FROM e""")
def q65(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 4 == 0, "candidate").when(k % 4 == 1, "baseline").when(k % 4 == 2, "other").alias("outcome"), (k % 3 == 0).alias("promotion_eligible"), (k % 6 == 0).alias("beats"), F.lit("moving_average").alias("baseline"), F.lit("v1").alias("version")
    )
    return C.selected_predictor(rows).select("c_custkey", "problem", "model")


@query("q66_command_problems", """WITH c AS (SELECT o_orderkey, 'tenant-' || (o_custkey % 4) AS tenant_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS parent_id, CASE WHEN o_orderkey % 17 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'e' || o_custkey END AS causation_id FROM orders),
p AS (SELECT c.*, CAST(c_custkey AS VARCHAR) AS there, parent_id IS NULL AS root, row_number() OVER (PARTITION BY tenant_id, parent_id ORDER BY o_orderkey) AS n FROM c LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 7) q ON CAST(q.c_custkey AS VARCHAR) = c.parent_id)
SELECT o_orderkey AS command_id, CASE WHEN root AND causation_id IS NOT NULL THEN 'root has a cause' WHEN NOT root AND there IS NULL THEN 'missing parent' WHEN NOT root AND causation_id = 'x' THEN 'cause is not the parent''s event' ELSE 'parent is taken' END AS problem
FROM p WHERE (root AND causation_id IS NOT NULL) OR (NOT root AND (there IS NULL OR causation_id = 'x' OR n > 1))""")
def q66(spark, d):
    """Orders as commands under their customer, of whom every tenth is not there."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tenant = lambda c: F.concat(F.lit("tenant-"), (c % 4).cast("string")).alias("tenant_id")
    commands = table(spark, d, "orders").select(
        key.alias("command_id"), tenant(cust), key.cast("string").alias("entity_id"), F.when(key % 13 != 0, cust.cast("string")).alias("parent_id"), F.when(key % 17 == 0, "x").when(key % 13 != 0, F.concat(F.lit("e"), cust.cast("string"))).alias("causation_id")
    )
    own = F.col("c_custkey")
    parents = table(spark, d, "customer").where("c_custkey % 10 <> 7").select(tenant(own), own.cast("string").alias("entity_id"), F.concat(F.lit("e"), own.cast("string")).alias("event_id"), F.lit(1).alias("version"))
    return C.command_problems(commands, parents, parents)


@query("q67_accepted_again", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'insert' WHEN o_orderkey % 7 = 0 THEN 'conflict' ELSE 'keep' END AS effect FROM orders""")
def q67(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("content"))
    stored = rows.where("o_orderkey % 3 <> 0").withColumn("content", F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("content")))
    return C.accepted_again(stored, rows, "o_orderkey", "content").select("o_orderkey", "effect")


@query("q68_counter_families", """WITH e AS (SELECT CASE user_id % 3 WHEN 0 THEN 'publish' WHEN 1 THEN 'processing' ELSE 'http' END AS family, CASE event_id % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'applied' WHEN 2 THEN '2xx' WHEN 3 THEN 'failure' ELSE 'nonsense' END AS outcome FROM events)
SELECT family, outcome, (SELECT count(*) FROM e WHERE e.family = a.family AND e.outcome = a.outcome) AS n FROM (VALUES """ + ", ".join(f"('{f}', '{o}')" for f, v in D.COUNTERS.items() for o in v) + """) a(family, outcome)""")
def q68(spark, d):
    k = F.col("event_id") % 5
    outcome = F.when(k == 0, "published").when(k == 1, "applied").when(k == 2, "2xx").when(k == 3, "failure").otherwise("nonsense")
    family = F.when(F.col("user_id") % 3 == 0, "publish").when(F.col("user_id") % 3 == 1, "processing").otherwise("http")
    return D.counters(table(spark, d, "events").select(family.alias("family"), outcome.alias("outcome")))


@query("q69_effect_counts_json", """SELECT tenant_no, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS effects FROM (SELECT user_id % 4 AS tenant_no, event_type, count(*) AS n FROM events GROUP BY ALL) x GROUP BY tenant_no""")
def q69(spark, d):
    return D.effects_json(table(spark, d, "events").select((F.col("user_id") % 4).alias("tenant_no"), "event_type"), "tenant_no", "event_type")


@query("q70_assignment_lists", """SELECT 'p' || c_custkey || '-' || x AS principal_id, 'tenant-' || (c_custkey % 3) AS tenant_id, 'ops_reader' AS role_id, CAST(NULL AS VARCHAR) AS problem FROM customer, (SELECT unnest([1, 2]) AS x) WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
  UNION ALL SELECT NULL, NULL, NULL, CASE WHEN c_custkey % 5 = 0 THEN 'assignment contains an empty field' ELSE 'assignment must be principal|tenant|role' END FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0""")
def q70(spark, d):
    """Lists of two entries each, of which the second is broken in some: then the list has none."""
    key = F.col("c_custkey")
    tenant = F.concat(F.lit("|tenant-"), (key % 3).cast("string"), F.lit("| ops_reader"))
    entry = lambda n, rest: F.concat(F.lit(" p"), key.cast("string"), F.lit(f"-{n} "), rest)
    second = F.when(key % 5 == 0, F.lit("| |ops_reader ")).when(key % 7 == 0, F.lit("|tenant-1")).otherwise(tenant)
    return D.assignments(table(spark, d, "customer").select(F.concat(entry(1, tenant), F.lit(","), entry(2, second)).alias("value")))


@query("q71_session_freshness", """SELECT o_orderkey, o_orderkey % 9 <> 0 AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00' AS fresh, greatest(0, CAST(epoch(TIMESTAMP '1997-01-01 00:00:00') - epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT)) AS age FROM orders""")
def q71(spark, d):
    now = F.lit("1997-01-01 00:00:00").cast("timestamp")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("expires_at"), F.when(F.col("o_orderkey") % 9 != 0, "p").otherwise(" ").alias("principal_id"), F.lit("t").alias("tenant_id"))
    return rows.select("o_orderkey", D.fresh_session(now).alias("fresh"), D.age_seconds(now, F.col("expires_at")).alias("age"))


@query("q72_strict_artifacts", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'not one JSON document' WHEN c_custkey % 7 = 0 THEN 'document: unknown member more' WHEN c_custkey % 3 = 0 THEN 'id: not a string' WHEN c_custkey % 5 = 0 THEN 'n: not an integer' END AS problem,
  CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN c_custkey END AS n FROM customer""")
def q72(spark, d):
    """Documents with text behind them, a second document, an early end of what they are wrapped in, and wrong kinds."""
    key = F.col("c_custkey")
    nth = lambda n: key % n == 0
    id_ = F.when(nth(6), F.lit('{"a":1}')).when(nth(3), F.lit("5")).otherwise(F.lit('"x"'))
    n = F.when(nth(10), F.concat(key.cast("string"), F.lit(".5"))).when(nth(5), F.lit('"a"')).otherwise(key.cast("string"))
    text = F.concat(F.lit('{"id":'), id_, F.lit(',"n":'), n, F.when(nth(7), ',"more":1}').otherwise("}"))
    text = F.when(nth(11), F.lit("[1")).when(nth(13), F.concat(text, F.lit(" tail"))).when(nth(17), F.concat(text, F.lit(' {"id":"y"}'))).when(nth(19), F.concat(text, F.lit("] ["))).otherwise(text)
    return Z.strict(table(spark, d, "customer").select("c_custkey", text.alias("value")), {"id": "string", "n": "integer"}).select("c_custkey", "problem", "n")


@query("q72b_candidate_artifacts", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 101 = 0 THEN 'document' WHEN o_orderkey % 103 = 0 THEN 'sample' WHEN o_orderkey % 107 = 0 THEN 'member' END AS fault FROM orders),
a AS (SELECT o_custkey, CASE WHEN bool_or(fault = 'document') THEN 'not one JSON document' ELSE min_by(CASE fault WHEN 'sample' THEN 'predictions[].uncertainty.sample_count: not an integer' WHEN 'member' THEN 'predictions[].uncertainty: unknown member more' END, o_orderkey) FILTER (fault IS NOT NULL) END AS problem FROM o GROUP BY o_custkey)
SELECT o.o_custkey AS model, a.problem, CASE WHEN a.problem IS NULL THEN CAST(o_orderkey AS VARCHAR) END AS row_id, CASE WHEN a.problem IS NULL AND o_orderkey % 4 <> 0 THEN (o_orderkey % 100) / 100.0 END AS score, CASE WHEN a.problem IS NULL THEN CASE WHEN o_orderkey % 4 = 0 THEN 'insufficient_support' ELSE '' END END AS abstention_reason
FROM o JOIN a USING (o_custkey) WHERE a.problem IS NULL UNION ALL SELECT o_custkey, problem, NULL, NULL, NULL FROM a WHERE problem IS NOT NULL""")
def q72b(spark, d):
    """A customer's orders as the predictions of one artifact, with faults deep inside some."""
    key = F.col("o_orderkey")
    nth = lambda n: key % n == 0
    score = F.format_string("%.2f", (key % 100) / 100)
    more = F.concat(F.lit('"sample_count":'), F.when(nth(103), "1.5").otherwise("7"), F.when(nth(107) & ~nth(103), ',"more":null').otherwise(""))
    bounds = F.concat(F.lit(',"stockout_risk":'), score, F.lit(',"uncertainty":{"method":"m","lower":0,"upper":1,'), more, F.lit("}"))
    plain = F.concat(F.lit(',"abstention_reason":"insufficient_support","uncertainty":'), F.when(nth(103) | nth(107), F.concat(F.lit("{"), more, F.lit("}"))).otherwise("null"))
    one = F.concat(F.lit('{"row_id":"'), key.cast("string"), F.lit('","status":"'), F.when(nth(4), "abstained").otherwise("predicted"), F.lit('"'), F.when(nth(4), plain).otherwise(bounds), F.lit("}"))
    rows = table(spark, d, "orders").select("o_custkey", key.alias("k"), one.alias("p"), nth(101).alias("late"))
    texts = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]), ",").alias("all"), F.bool_or("late").alias("late"))
    text = F.concat(F.lit('{"artifact_version":1,"model_version":"m","predictions":['), "all", F.lit("]}"), F.when(F.col("late"), ",1").otherwise(""))
    found = written(Z.strict(texts.select(F.col("o_custkey").alias("model"), text.alias("value")), Z.ARTIFACT).select("model", "problem", "document"), "artifacts")
    nothing = F.lit(None).cast("string")
    wrong = found.where("problem IS NOT NULL").select("model", "problem", nothing.alias("row_id"), F.lit(None).cast("double").alias("score"), nothing.alias("abstention_reason"))
    return Z.predictions(found, "model", "problem").select("model", "problem", "row_id", "score", "abstention_reason").unionByName(wrong)


@query("q73_snapshot_at_cutoff", f"""WITH {DATASET_SQL.replace("), hist AS (", " WHERE g.d <= DATE '2024-01-20'), hist AS (", 1)} SELECT row_id, item_id, CAST(as_of_date AS VARCHAR) AS as_of_date, history_hash FROM ex""")
def q73(spark, d):
    rows = D.snapshot_rows(daily(spark, d), "2024-01-20", PROTOCOL, SPLITS)
    return rows.select("row_id", "item_id", F.col("as_of_date").cast("string").alias("as_of_date"), "history_hash")


CHAINS = "WITH s AS (SELECT 'supplier' AS kind, s_suppkey AS id, NULL AS parent FROM supplier UNION ALL SELECT 'ingredient_lot', p_partkey, p_partkey % (SELECT count(*) FROM supplier) + 1 FROM part UNION ALL SELECT 'production_batch', c_custkey, c_custkey % (SELECT count(*) FROM part) + 1 FROM customer)"


@query("q74_lineage_chain_fold", CHAINS + """ SELECT kind AS aggregate_type, CASE WHEN parent IS NULL OR row_number() OVER (PARTITION BY kind, parent ORDER BY id) = 1 THEN 'applied' ELSE 'quarantined_invalid' END AS disposition, id FROM s""")
def q74(spark, d):
    """Suppliers, parts as lots under them and customers as batches of lots: a parent is taken by the first that names it."""
    n_suppliers, n_parts = (table(spark, d, t).agg(F.count("*").alias("n")) for t in ("supplier", "part"))
    own = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.lit(None).cast("long").alias("parent"))
    lots = table(spark, d, "part").join(F.broadcast(n_suppliers)).select(F.lit("ingredient_lot"), "p_partkey", F.col("p_partkey") % F.col("n") + 1)
    batches = table(spark, d, "customer").join(F.broadcast(n_parts)).select(F.lit("production_batch"), "c_custkey", F.col("c_custkey") % F.col("n") + 1)
    rows = own.union(lots).union(batches)
    states = R.inbox(R.fold(R.with_groups(_hops(rows, F.col("id"))))).select("event_id", "disposition")
    parts = F.split("event_id", "/")
    return states.select(parts[0].alias("aggregate_type"), "disposition", parts[1].cast("long").alias("id"))


def _hops(rows: DataFrame, seq, order=None) -> DataFrame:
    """Rows (kind, id, parent) as first deliveries of hops, all of one tenant."""
    nothing = F.lit(None)
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        seq.cast("long").alias("seq"), nothing.cast("string").alias("log_key"), F.concat_ws("/", "kind", text("id")).alias("event_id"), F.lit("tenant-1").alias("tenant_id"), F.col("kind").alias("aggregate_type"), text("id").alias("aggregate_id"),
        F.lit(1).cast("long").alias("version"), nothing.cast("long").alias("before"), nothing.cast("long").alias("after"), text("parent").alias("parent_id"), (nothing.cast("string") if order is None else order).alias("order_id"), F.lit("x").alias("content_hash"),
    )


@query("q74b_lineage_two_unique_keys", """WITH RECURSIVE s AS (SELECT o_orderkey AS seq, o_orderkey * 7919 % (SELECT count(*) FROM part) AS p, o_custkey AS o FROM orders),
g AS (SELECT 0 AS it, seq, p, o, 'open' AS st FROM s UNION ALL
  SELECT it + 1, seq, p, o, CASE WHEN win THEN 'won' WHEN bool_or(win) OVER (PARTITION BY p) OR bool_or(win) OVER (PARTITION BY o) THEN 'lost' ELSE 'open' END
  FROM (SELECT *, seq = min(seq) OVER (PARTITION BY p) AND seq = min(seq) OVER (PARTITION BY o) AS win FROM g WHERE st = 'open') x)
SELECT seq, CASE st WHEN 'won' THEN 'applied' ELSE 'quarantined_invalid' END AS disposition FROM g WHERE st <> 'open'""")
def q74b(spark, d):
    """Orders as shipments of a part's batch to a customer: both may be taken once, in the order of arrival."""
    n = F.broadcast(table(spark, d, "part").agg(F.count("*").alias("n")))
    rows = table(spark, d, "orders").join(n).select(F.lit("shipment").alias("kind"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % F.col("n")).alias("parent"), F.col("o_custkey").cast("string").alias("o"))
    return L.fold_hops(_hops(rows, F.col("id"), F.col("o"))).select("seq", "disposition")


@query("q66b_commands_accepted", """WITH RECURSIVE np AS (SELECT count(*) AS np FROM part), ns AS (SELECT count(*) AS ns FROM supplier),
lot AS (SELECT 1000000000 + p_partkey AS seq, p_partkey AS id, p_partkey % (ns + 3) AS parent, CASE WHEN p_partkey % (ns + 3) NOT IN (SELECT s_suppkey FROM supplier) THEN 'unknown lineage source' WHEN p_partkey % 7 = 6 THEN 'unknown inventory item' WHEN p_partkey % 11 = 0 THEN 'invalid transition' END AS problem FROM part, ns),
lots AS (SELECT *, coalesce(problem, CASE WHEN row_number() OVER (PARTITION BY problem, parent ORDER BY seq) > 1 THEN 'duplicate source' ELSE 'accepted' END) AS outcome FROM lot),
batch AS (SELECT CASE WHEN c_custkey % 17 = 0 THEN c_custkey - 1000000 ELSE 2000000000 + c_custkey END AS seq, c_custkey AS id, c_custkey % (np + 5) AS parent FROM customer, np),
batches AS (SELECT *, coalesce(problem, CASE WHEN row_number() OVER (PARTITION BY problem, parent ORDER BY seq) > 1 THEN 'duplicate source' ELSE 'accepted' END) AS outcome FROM (SELECT batch.*, CASE WHEN l.seq IS NULL OR l.seq >= batch.seq THEN 'unknown lineage source' WHEN batch.id % 11 = 0 THEN 'invalid transition' END AS problem
  FROM batch LEFT JOIN (SELECT * FROM lots WHERE outcome = 'accepted') l ON l.id = batch.parent) x),
shipments AS (SELECT *, coalesce(problem, CASE WHEN row_number() OVER (PARTITION BY problem, parent ORDER BY seq) > 1 THEN 'duplicate source' ELSE 'accepted' END) AS outcome FROM (SELECT 3000000000 + o_orderkey AS seq, o_orderkey AS id, o_custkey AS parent, CASE WHEN b.id IS NULL THEN 'unknown lineage source' END AS problem
  FROM orders LEFT JOIN (SELECT * FROM batches WHERE outcome = 'accepted') b ON b.id = o_custkey) x),
o AS (SELECT 4000000000 + o_orderkey AS seq, o_custkey % 7 AS item, o_orderkey % 5 AS q, (s.outcome = 'accepted') = (o_orderkey % 2 = 0) AS sound FROM orders JOIN shipments s ON s.id = o_orderkey),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS rn FROM o WHERE sound AND q >= 1 AND item < 6),
f AS (SELECT item, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS before, CAST(300 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS version, false AS ok FROM (SELECT DISTINCT item FROM n) x
  UNION ALL SELECT n.item, n.rn, n.seq, f.rest, CASE WHEN f.rest >= n.q THEN f.rest - n.q ELSE f.rest END, CASE WHEN f.rest >= n.q THEN f.version + 1 ELSE f.version END, f.rest >= n.q FROM f JOIN n ON n.item = f.item AND n.rn = f.rn + 1)
SELECT s_suppkey AS seq, 'accepted' AS outcome, NULL AS quantity_before, NULL AS quantity_after, NULL AS aggregate_version FROM supplier UNION ALL SELECT seq, outcome, NULL, NULL, NULL FROM lots UNION ALL SELECT seq, outcome, NULL, NULL, NULL FROM batches
UNION ALL SELECT seq, outcome, NULL, NULL, NULL FROM shipments UNION ALL SELECT o.seq, CASE WHEN q < 1 THEN 'invalid quantity' WHEN o.item = 6 THEN 'unknown inventory item' WHEN f.ok THEN 'accepted' ELSE 'invalid transition' END,
  CASE WHEN f.ok THEN f.before END, CASE WHEN f.ok THEN f.rest END, CASE WHEN f.ok THEN f.version END FROM o LEFT JOIN f ON f.seq = o.seq""")
def q66b(spark, d):
    """Suppliers, parts as lots, customers as batches, orders as shipments and as orders of them, in one batch of commands."""
    count = lambda name, n: F.broadcast(table(spark, d, name).agg(F.count("*").alias(n)))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    nothing = F.lit(None).cast("string")

    def made(rows, kind, seq, entity, parent, item, order, event, cause, quantity=None):
        amount = (F.lit(None) if quantity is None else quantity).cast("long")
        return rows.select(
            seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit("t").alias("tenant_id"), entity.alias("entity_id"), parent.alias("parent_id"), item.alias("item_id"), order.alias("order_id"), amount.alias("quantity"), event.alias("event_id"), cause.alias("causation_id")
        )

    s, p, c, o, cust = (F.col(x) for x in ("s_suppkey", "p_partkey", "c_custkey", "o_orderkey", "o_custkey"))
    supplier = made(table(spark, d, "supplier"), "supplier", s, text("s", s), nothing, nothing, nothing, text("e-s", s), nothing)
    of, to = p % (F.col("ns") + 3), c % (F.col("np") + 5)
    lots = made(table(spark, d, "part").join(count("supplier", "ns")), "ingredient_lot", p + 10**9, text("l", p), text("s", of), text("i", p % 7), nothing, text("e-l", p), F.when(p % 11 == 0, "x").otherwise(text("e-s", of)))
    batches = made(table(spark, d, "customer").join(count("part", "np")), "production_batch", F.when(c % 17 == 0, c - 10**6).otherwise(c + 2 * 10**9), text("b", c), text("l", to), nothing, nothing, text("e-b", c), F.when(c % 11 == 0, "x").otherwise(text("e-l", to)))
    orders = table(spark, d, "orders")
    shipments = made(orders, "shipment", o + 3 * 10**9, text("h", o), text("b", cust), nothing, text("o", o), text("e-h", o), text("e-b", cust))
    asked = made(orders, "order", o + 4 * 10**9, nothing, nothing, text("i", cust % 7), text("o", o), text("e-o", o), F.when(o % 2 == 0, text("e-h", o)), o % 5)
    rows = written(supplier.union(lots).union(batches).union(shipments).union(asked), "commands")
    stock = spark.range(6).select(F.lit("t").alias("tenant_id"), text("i", F.col("id")).alias("item_id"), F.lit(300).cast("long").alias("quantity_on_hand"), F.lit(0).cast("long").alias("aggregate_version"))
    stored = rows.where("false").select("kind", "tenant_id", "entity_id", "parent_id", "order_id", "event_id")
    return K.accept(rows, stored, stock)
