"""Queries over daily series: labels, splits, hashes, features, baselines, the bucket-rate model and its evaluation.

The series are each user's numbers of events on the 30 days that the events table covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.functions.text import line, sha256
from eventfold.operators import evaluation as E
from eventfold.operators import predictions as P
from eventfold.operators import series as S
from eventfold.operators.versioned import LOG_SQL, log
from eventfold.plans.registry import query
from eventfold.sources.tables import table, written

START, DAYS = "2024-01-01", 30
SPLITS = (("train", 14), ("validation", 4), ("test", 5))
PROTOCOL = "daily-activity-v1"
SNAPSHOT = "snapshot-1"

DAILY_SQL = f"""daily AS (
  SELECT i.tenant_id, i.item_id, g.d AS as_of_date, CAST(coalesce(c.n, 0) AS BIGINT) AS quantity_on_hand
  FROM (SELECT DISTINCT 'tenant-' || (user_id % 4) AS tenant_id, CAST(user_id AS VARCHAR) AS item_id FROM events) i
  CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{START}' + {DAYS - 1}, INTERVAL 1 DAY)) AS DATE) AS d) g
  LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) c ON c.item_id = i.item_id AND c.d = g.d)"""
DATASET_SQL = f"""{DAILY_SQL}, hist AS (
  SELECT *, count(*) OVER w AS ahead, max(CASE WHEN quantity_on_hand = 0 THEN 1 ELSE 0 END) OVER w AS label,
    sha256(string_agg(CAST(as_of_date AS VARCHAR) || chr(9) || quantity_on_hand || chr(10), '') OVER (PARTITION BY tenant_id, item_id ORDER BY as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS history_hash
  FROM daily WINDOW w AS (PARTITION BY tenant_id, item_id ORDER BY as_of_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
idx AS (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) AS date_no FROM (SELECT DISTINCT as_of_date FROM hist WHERE ahead = 7) x),
ex AS (SELECT sha256('{PROTOCOL}' || chr(9) || tenant_id || chr(9) || item_id || chr(9) || CAST(as_of_date AS VARCHAR) || chr(10)) AS row_id, tenant_id, item_id, as_of_date, label,
  CASE WHEN date_no <= 14 THEN 'train' WHEN date_no <= 18 THEN 'validation' ELSE 'test' END AS split, history_hash, quantity_on_hand
  FROM hist JOIN idx USING (as_of_date) WHERE ahead = 7 AND date_no <= 23)"""
MODEL_SQL = f"""{DATASET_SQL}, bk AS (SELECT *, CASE WHEN quantity_on_hand = 0 THEN 'zero' WHEN quantity_on_hand <= 2 THEN 'low' WHEN quantity_on_hand <= 7 THEN 'medium' ELSE 'high' END AS bucket FROM ex),
fit AS (SELECT bucket, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM bk WHERE split = 'train' GROUP BY bucket),
rate AS (SELECT bucket, n, positives, CASE WHEN n >= 5 THEN (positives + 1) / (n + 2) END AS score FROM fit),
ci AS (SELECT *, positives / n AS p, ((positives / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 / (1 + 3.8416 / n) * sqrt((positives / n) * (1 - positives / n) / n + 3.8416 / (4 * n * n)) AS half FROM rate),
candidate AS (SELECT bk.row_id, bk.split, bk.label, rate.score FROM bk LEFT JOIN rate USING (bucket)),
ma AS (SELECT row_id, split, label, CASE WHEN count(*) OVER w = 7 THEN sum(CASE WHEN quantity_on_hand = 0 THEN 1 ELSE 0 END) OVER w / 7.0 END AS score FROM ex WINDOW w AS (PARTITION BY tenant_id, item_id ORDER BY as_of_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
sn AS (SELECT row_id, split, label, CAST(lag(label, 7) OVER (PARTITION BY tenant_id, item_id ORDER BY as_of_date) AS DOUBLE) AS score FROM ex),
scored AS (SELECT 'bucket_rate' AS model, * FROM candidate UNION ALL SELECT 'moving_average', * FROM ma UNION ALL SELECT 'seasonal_naive', * FROM sn),
ranked AS (SELECT *, row_number() OVER o AS r, sum(label) OVER (PARTITION BY model, split ORDER BY score DESC NULLS LAST, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM scored WHERE score IS NOT NULL WINDOW o AS (PARTITION BY model, split ORDER BY score DESC NULLS LAST, row_id)),
ap AS (SELECT model, split, sum(CASE WHEN label = 1 THEN hits / r ELSE 0 END) / sum(label) AS ap, avg((score - label) * (score - label)) AS brier, count(*) AS predicted FROM ranked GROUP BY ALL),
result AS (SELECT s.model, s.split, count(*) AS n, max(ap.predicted) AS predicted, max(ap.ap) AS ap, max(ap.brier) AS brier FROM scored s JOIN ap ON ap.model = s.model AND ap.split = s.split GROUP BY ALL)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Dense series: the calendar is generated for each item, no days are joined in."""
    events = table(spark, d, "events")
    user = F.col("user_id")
    counts = events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    per_item = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("by_day"))
    days = F.explode(F.sequence(F.lit(START).cast("date"), F.date_add(F.lit(START).cast("date"), DAYS - 1))).alias("as_of_date")
    rows = per_item.select(F.concat(F.lit("tenant-"), (user % 4).cast("string")).alias("tenant_id"), user.cast("string").alias("item_id"), "by_day", days)
    return rows.select("tenant_id", "item_id", "as_of_date", F.coalesce(F.try_element_at("by_day", F.col("as_of_date")), F.lit(0)).cast("long").alias("quantity_on_hand"))


def examples(spark: SparkSession, d: str, hashed: bool = False) -> DataFrame:
    return S.dataset(daily(spark, d), PROTOCOL, SPLITS, hashed=hashed)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all three models on one pass over the examples."""
    rows = written(examples(spark, d), "examples").withColumns({"moving_average": S.moving_average(), "seasonal_naive": S.seasonal_naive()})
    rows = E.predict_rates(rows).withColumnRenamed("score", "bucket_rate")
    models = F.explode(F.create_map(*(x for m in ("bucket_rate", "moving_average", "seasonal_naive") for x in (F.lit(m), F.col(m)))))
    return rows.select("row_id", "split", "label", models.alias("model", "score"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return E.evaluate(written(scored(spark, d), "scored"), ("model", "split"))


def _date(c: str = "as_of_date"):
    return F.col(c).cast("string").alias(c)


@query("q24_daily_on_hand_dense", f"WITH {LOG_SQL}, {DAILY_SQL}, last AS (SELECT CAST(item_id AS VARCHAR) AS item_id, CAST(ts AS DATE) AS d, max_by(after_qty, version) AS q, max_by(before_qty, -version) AS b FROM log GROUP BY ALL), first AS (SELECT CAST(item_id AS VARCHAR) AS item_id, max(before_qty) AS b FROM log GROUP BY ALL)" + """
SELECT daily.item_id, CAST(daily.as_of_date AS VARCHAR) AS as_of_date, coalesce(last_value(last.q IGNORE NULLS) OVER (PARTITION BY daily.item_id ORDER BY daily.as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first.b) AS quantity_on_hand
FROM daily LEFT JOIN last ON last.item_id = daily.item_id AND last.d = daily.as_of_date JOIN first ON first.item_id = daily.item_id""")
def q24(spark, d):
    """Each day's last quantity, carried forward within the item's own array of days."""
    rows = log(spark, d)
    per_day = rows.groupBy("item_id", F.to_date("ts").alias("d")).agg(F.max_by("after_qty", "version").alias("q"), F.max("before_qty").alias("b"))
    per_item = per_day.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("d", "q"))).alias("days"), F.max("b").alias("first"))
    day = F.explode(F.sequence(F.lit(START).cast("date"), F.date_add(F.lit(START).cast("date"), DAYS - 1))).alias("as_of_date")
    rows = per_item.select("item_id", "days", "first", day)
    last = F.element_at(F.filter("days", lambda x: x["d"] <= F.col("as_of_date")), -1)
    known = F.size(F.filter("days", lambda x: x["d"] <= F.col("as_of_date"))) > 0
    return rows.select(F.col("item_id").cast("string").alias("item_id"), _date(), F.when(known, last["q"]).otherwise(F.col("first")).alias("quantity_on_hand"))


@query("q25_label_next7_zero", f"WITH {DATASET_SQL} SELECT item_id, CAST(as_of_date AS VARCHAR) AS as_of_date, label FROM hist WHERE ahead = 7")
def q25(spark, d):
    return S.with_labels(daily(spark, d)).select("item_id", _date(), "label")


@query("q26_chronological_splits", f"WITH {DATASET_SQL} SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, date_no, CASE WHEN date_no <= 14 THEN 'train' WHEN date_no <= 18 THEN 'validation' WHEN date_no <= 23 THEN 'test' END AS split FROM idx")
def q26(spark, d):
    return S.split_dates(S.with_labels(daily(spark, d)), SPLITS).select(_date(), "date_no", "split")


@query("q27_history_hash", f"WITH {DATASET_SQL} SELECT item_id, CAST(as_of_date AS VARCHAR) AS as_of_date, history_hash FROM hist")
def q27(spark, d):
    return S.with_history_hash(daily(spark, d)).select("item_id", _date(), "history_hash")


@query("q28_dataset_checksum", f"WITH {DATASET_SQL} SELECT tenant_id, sha256(string_agg(row_id || chr(9) || tenant_id || chr(9) || item_id || chr(9) || CAST(as_of_date AS VARCHAR) || chr(9) || label || chr(9) || split || chr(9) || CAST(as_of_date AS VARCHAR) || chr(9) || history_hash || chr(10), '' ORDER BY item_id, as_of_date)) AS checksum FROM ex GROUP BY tenant_id")
def q28(spark, d):
    return S.dataset_checksum(examples(spark, d, hashed=True), ("tenant_id",))


@query("q29_feature_rows", f"WITH {DATASET_SQL} SELECT row_id, tenant_id, item_id, CAST(as_of_date AS VARCHAR) AS as_of_date, split, quantity_on_hand, history_hash FROM ex")
def q29(spark, d):
    return examples(spark, d, hashed=True).select("row_id", "tenant_id", "item_id", _date(), "split", "quantity_on_hand", "history_hash")


@query("q30_moving_average_baseline", f"WITH {MODEL_SQL} SELECT row_id, split, round(score, 9) AS score FROM ma")
def q30(spark, d):
    return examples(spark, d).withColumn("score", F.round(S.moving_average(), 9)).select("row_id", "split", "score")


@query("q31_seasonal_naive_baseline", f"WITH {MODEL_SQL} SELECT row_id, split, score FROM sn")
def q31(spark, d):
    return examples(spark, d).withColumn("score", S.seasonal_naive()).select("row_id", "split", "score")


@query("q32_runtime_seasonal_naive", f"""WITH {DATASET_SQL}, f AS (SELECT row_id, item_id, as_of_date, quantity_on_hand FROM ex),
steps AS (SELECT a.row_id, o.o, b.quantity_on_hand AS q FROM f a CROSS JOIN (SELECT unnest(range(0, 7)) AS o) o LEFT JOIN f b ON b.item_id = a.item_id AND b.as_of_date = a.as_of_date - 6 + CAST(o.o AS INTEGER) AND date_diff('day', DATE '{START}', b.as_of_date) % 11 <> 3),
ends AS (SELECT row_id, min(o) FILTER (q = 0) AS zero, min(o) FILTER (q IS NULL) AS hole FROM steps GROUP BY row_id)
SELECT row_id, CASE WHEN zero IS NOT NULL AND (hole IS NULL OR zero < hole) THEN 1.0::DOUBLE WHEN zero IS NULL AND hole IS NULL THEN 0.0::DOUBLE END AS score FROM ends""")
def q32(spark, d):
    """Every example is scored; on every eleventh day nothing is known."""
    known = F.datediff("as_of_date", F.lit(START).cast("date")) % 11 != 3
    rows = examples(spark, d).withColumn("quantity_on_hand", F.when(known, F.col("quantity_on_hand")))
    return rows.withColumn("score", S.runtime_seasonal_naive()).select("row_id", "score")


@query("q33_bucket_rate_fit", f"WITH {MODEL_SQL} SELECT bucket, n, positives, round(score, 9) AS rate FROM rate")
def q33(spark, d):
    return E.rates(E.fit_rates(examples(spark, d))).select("bucket", "n", "positives", F.round("rate", 9).alias("rate"))


@query("q34_wilson_interval", f"WITH {MODEL_SQL} SELECT bucket, round(least(greatest(0, mid - half), score), 9) AS lower, round(greatest(least(1, mid + half), score), 9) AS upper FROM ci WHERE score IS NOT NULL")
def q34(spark, d):
    return E.rates(E.fit_rates(examples(spark, d))).where("rate IS NOT NULL").select("bucket", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query("q35_average_precision_by_split", f"WITH {MODEL_SQL} SELECT model, split, n, predicted, round(ap, 9) AS ap FROM result")
def q35(spark, d):
    return results(spark, d).select("model", "split", "n", "predicted", F.round("ap", 9).alias("ap"))


@query("q36_brier_by_split", f"WITH {MODEL_SQL} SELECT model, split, round(brier, 9) AS brier FROM result")
def q36(spark, d):
    return results(spark, d).select("model", "split", F.round("brier", 9).alias("brier"))


BEST_SQL = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ap DESC, brier, predicted / n DESC, model) AS place FROM result WHERE model <> 'bucket_rate' AND predicted * 100 >= n * 80) x WHERE place = 1)"


@query("q37_baseline_selection", f"WITH {MODEL_SQL}, {BEST_SQL} SELECT split, model FROM best")
def q37(spark, d):
    return E.best(results(spark, d).where("model <> 'bucket_rate'")).select("split", "model")


@query("q38_candidate_promotion", f"WITH {MODEL_SQL}, {BEST_SQL} SELECT c.split, b.model AS baseline, coalesce(c.ap > b.ap AND c.brier <= b.brier, FALSE) AS promoted FROM result c LEFT JOIN best b ON b.split = c.split WHERE c.model = 'bucket_rate'")
def q38(spark, d):
    """Both sides of a split are taken from its rows in one aggregation."""
    candidate = F.col("model") == "bucket_rate"
    own = F.max(F.when(candidate, F.struct(F.col("ap").alias("candidate_ap"), F.col("brier").alias("candidate_brier")))).alias("own")
    base = F.min(F.when(~candidate & E.qualifies(), F.struct(-F.col("ap"), "brier", -F.col("coverage"), F.col("model").alias("baseline"), "ap"))).alias("base")
    sides = results(spark, d).groupBy("split").agg(own, base).where("own IS NOT NULL").select("split", "own.*", "base.baseline", "base.ap", "base.brier")
    return sides.select("split", "baseline", E.promoted().alias("promoted"))


PRED_SQL = f"""pred AS (SELECT event_id AS prediction_id, 'tenant-' || (user_id % 4) AS tenant_id, CAST(user_id AS VARCHAR) AS item_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS observation_date, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at,
  '{SNAPSHOT}' || '-' || (event_id % 3) AS snapshot_id, value / 100 AS score FROM events)"""


def _predictions(spark, d):
    user = F.col("user_id")
    return table(spark, d, "events").select(
        F.col("event_id").alias("prediction_id"), F.concat(F.lit("tenant-"), (user % 4).cast("string")).alias("tenant_id"), user.cast("string").alias("item_id"), F.to_date("ts").cast("string").alias("observation_date"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_at"), F.concat(F.lit(f"{SNAPSHOT}-"), (F.col("event_id") % 3).cast("string")).alias("snapshot_id"), (F.col("value") / 100).alias("score"),
    )


@query("q39_prediction_latest", f"WITH {PRED_SQL} SELECT tenant_id, item_id, prediction_id, observation_date FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, item_id ORDER BY observation_date DESC, recorded_at DESC, prediction_id DESC) AS n FROM pred) x WHERE n = 1")
def q39(spark, d):
    return P.latest(_predictions(spark, d)).select("tenant_id", "item_id", "prediction_id", "observation_date")


@query("q40_prediction_identity", f"WITH {PRED_SQL} SELECT prediction_id, sha256(tenant_id || chr(9) || item_id || chr(9) || observation_date || chr(9) || '7' || chr(9) || '{PROTOCOL}' || chr(9) || 'raw-v1' || chr(9) || snapshot_id || chr(9) || sha256(snapshot_id) || chr(10)) AS identity FROM pred")
def q40(spark, d):
    extra = {"horizon_days": F.lit(7), "dataset_version": F.lit(PROTOCOL), "feature_definition_version": F.lit("raw-v1"), "snapshot_checksum": sha256(F.col("snapshot_id"))}
    return _predictions(spark, d).withColumns(extra).select("prediction_id", P.identity().alias("identity"))


@query("q41_prediction_conflicts", """WITH pred AS (SELECT event_id % 2000 AS prediction_id, CASE WHEN event_id < 2000 THEN 0 ELSE event_id % 7 END AS content, event_id FROM events),
first AS (SELECT prediction_id, min(event_id) AS event_id FROM pred GROUP BY prediction_id), stored AS (SELECT pred.prediction_id, content FROM pred JOIN first USING (event_id) WHERE pred.prediction_id % 5 <> 0),
new AS (SELECT pred.prediction_id, min(content) AS content FROM pred JOIN first USING (prediction_id) WHERE pred.event_id > first.event_id OR pred.prediction_id % 5 = 0 GROUP BY pred.prediction_id)
SELECT new.prediction_id, CASE WHEN stored.prediction_id IS NULL THEN 'append' WHEN stored.content = new.content THEN 'keep' ELSE 'conflict' END AS effect FROM new LEFT JOIN stored USING (prediction_id)""")
def q41(spark, d):
    """Each prediction's first delivery is stored, but for every fifth, of which nothing is; all later deliveries are new."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 2000).alias("prediction_id"), F.when(F.col("event_id") < 2000, 0).otherwise(F.col("event_id") % 7).alias("content"))
    rows = rows.withColumn("stored", (F.col("event_id") == F.min("event_id").over(Window.partitionBy("prediction_id"))) & (F.col("prediction_id") % 5 != 0))
    own = ["prediction_id", "content"]
    return P.persist(rows.where("stored").select(own), rows.where("NOT stored").select(own)).select("prediction_id", "effect")


@query("q42_freshness_status", f"""WITH {PRED_SQL}, cur AS (SELECT DISTINCT tenant_id, item_id, observation_date, snapshot_id FROM pred WHERE prediction_id % 2 = 0)
SELECT p.prediction_id, CASE WHEN p.tenant_id = 'tenant-3' THEN 'unavailable' WHEN cur.item_id IS NOT NULL AND p.tenant_id <> 'tenant-2' THEN 'fresh' ELSE 'stale' END AS freshness
FROM pred p LEFT JOIN cur ON p.tenant_id = cur.tenant_id AND p.item_id = cur.item_id AND p.observation_date = cur.observation_date AND p.snapshot_id = cur.snapshot_id""")
def q42(spark, d):
    rows = _predictions(spark, d)
    status = F.when(F.col("tenant_id") == "tenant-3", "incomplete").when(F.col("tenant_id") == "tenant-2", "stale").otherwise("complete")
    return P.freshness(rows, rows.where("prediction_id % 2 = 0"), status).select("prediction_id", "freshness")


@query("q33b_quality_rate_by_length", """WITH b AS (SELECT l.doc_id, l.quality AS label, CASE WHEN n_chars = 0 THEN 'zero' WHEN n_chars / 500 <= 2 THEN 'low' WHEN n_chars / 500 <= 7 THEN 'medium' ELSE 'high' END AS bucket FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT bucket, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(CASE WHEN count(*) >= 5 THEN (sum(label) + 1) / (count(*) + 2) END, 9) AS rate FROM b GROUP BY bucket""")
def q33b(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 500).alias("quantity_on_hand")), "doc_id")
    fit = E.fit_rates(rows.withColumn("split", F.lit("train")))
    return E.rates(fit).select("bucket", "n", "positives", F.round("rate", 9).alias("rate"))
