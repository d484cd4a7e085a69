"""Golden hashes and metrics of the generated history, and properties of the series operators."""

import pytest
from pyspark.sql import functions as F

from eventfold.operators import evaluation as E
from eventfold.operators import series as S
from eventfold.sources import generators as G

DATASET = "b29e795cbacd0a40ee2b7c15c0d52200a867fa24554f50b7f77989302c8e116a"
HEADER = {
    "contract": 1, "status": "complete", "tenant": G.TENANTS[0], "dataset": S.PROTOCOL, "features": "m4-raw-onhand-v1", "history": "m4-official-history-v1",
    "projection": "m4-official-projection-v1", "max_recorded_at": "2026-04-26T23:59:59Z", "cutoff": "", "applied": 448,
}
FEATURES = "808980035fd123badb12df34224a8b510683d93dffbc1d8fde3df28590be4d78"
SNAPSHOT = "2d4121bb6804b9dbe9ee0d3d68989e9271e348a3c3ddf0727df5d53428035fc6"
#: ap and brier of the model and of the best baseline.
METRICS = {
    "train": (0.957489696104, 0.036397378241, "moving_average", 0.962987425654, 0.170493197279),
    "validation": (0.963827614379, 0.126833502348, "seasonal_naive", 1.0, 0.0),
    "test": (0.953728663154, 0.126833502348, "seasonal_naive", 1.0, 0.0),
}


@pytest.fixture(scope="module")
def history(spark):
    return G.history(spark).cache()


@pytest.fixture(scope="module")
def rows(history):
    return S.dataset(history.where(F.col("tenant_id") == G.TENANTS[0])).cache()


def test_dataset_checksum(rows):
    assert S.dataset_checksum(rows).first()["checksum"] == DATASET
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 210, "validation": 42, "test": 63}


def test_empty_checksum(rows):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert S.dataset_checksum(rows.where("false")).first()["checksum"] == empty


def test_feature_snapshot(rows):
    found = S.feature_snapshot(rows, HEADER).first()
    assert (found["checksum"], found["snapshot_id"]) == (FEATURES, SNAPSHOT)


def test_metrics(rows):
    scored = rows.withColumns({"moving_average": S.moving_average(), "seasonal_naive": S.seasonal_naive()})
    base = None
    for m in ("moving_average", "seasonal_naive"):
        one = scored.select("row_id", "split", "label", F.lit(m).alias("model"), F.col(m).alias("score"))
        base = one if base is None else base.unionByName(one)
    best = {r["split"]: r for r in E.best(E.evaluate(base, ("model", "split"))).collect()}
    own = {r["split"]: r for r in E.evaluate(E.predict_rates(rows).select("row_id", "split", "label", "score")).collect()}
    for split, (ap, brier, model, base_ap, base_brier) in METRICS.items():
        assert own[split]["ap"] == pytest.approx(ap, abs=1e-12) and own[split]["brier"] == pytest.approx(brier, abs=1e-12)
        assert best[split]["model"] == model and best[split]["ap"] == pytest.approx(base_ap, abs=1e-12) and best[split]["brier"] == pytest.approx(base_brier, abs=1e-12)


def test_the_future_does_not_leak(history):
    changed = history.withColumn("quantity_on_hand", F.when(F.col("as_of_date") > "2026-03-01", 7).otherwise(F.col("quantity_on_hand")))
    past = F.col("as_of_date") <= "2026-03-01"
    key = lambda h: {(r["item_id"], r["as_of_date"], r["history_hash"]) for r in S.with_history_hash(h).where(past).collect()}
    assert key(history) == key(changed)


def test_order_of_rows_does_not_matter(history):
    mixed = history.orderBy(F.rand(7)).where(F.col("tenant_id") == G.TENANTS[0])
    assert S.dataset_checksum(S.dataset(mixed)).first()["checksum"] == DATASET


def test_violations(spark):
    bad = spark.createDataFrame(
        [("t", "gap", "2026-01-01", 1), ("t", "gap", "2026-01-03", 1), ("t", "twice", "2026-01-01", 1), ("t", "twice", "2026-01-01", 2), ("t", "low", "2026-01-01", -1), ("t", "", "2026-01-01", 1), ("t", "none", None, 1)],
        "tenant_id string, item_id string, d string, quantity_on_hand long",
    ).withColumn("as_of_date", F.col("d").cast("date"))
    found = {(r["item_id"], r["reason"]) for r in S.violations(bad).collect()}
    assert {("gap", "gap"), ("twice", "duplicate date"), ("low", "negative quantity"), ("", "empty item"), ("none", "bad date")} <= found


def test_average_precision_by_hand_and_undefined(spark):
    rows = spark.createDataFrame(
        [("a", "s", 1, 0.9), ("b", "s", 0, 0.8), ("c", "s", 1, 0.7), ("d", "s", 0, 0.1), ("e", "one", 1, 0.5), ("f", "none", 1, None), ("g", "none", 0, None), ("h", "no ap", 0, 0.2), ("i", "no ap", 1, None)],
        "row_id string, split string, label int, score double",
    )
    found = {r["split"]: r for r in E.evaluate(rows).collect()}
    assert found["s"]["ap"] == pytest.approx((1 + 2 / 3) / 2) and found["one"]["reason"] == "degenerate class" and found["none"]["reason"] == "all abstained"
    assert found["no ap"]["reason"] == "undefined average precision" and found["no ap"]["brier"] == pytest.approx(0.04)


def test_bijection(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    right = spark.createDataFrame([("b",), ("c",)], "k string")
    assert {(r["k"], r["problem"]) for r in E.bijection_problems(left, right, ["k"]).collect()} == {("a", "missing right"), ("b", "duplicate"), ("c", "missing left")}
