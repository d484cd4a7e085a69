"""Delivery orders of the fold, lineage, rebuilds, queue transitions, access."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventfold.functions.text import line, ordered_hash
from eventfold.operators import access, outbox, reads, replay, validation
from eventfold.operators import fold as R
from eventfold.operators import predictions as P


def record(event, version, before=None, after=None, item="flour", hash_=None, kind="inventory_item", tenant="t1", parent=None, order=None, key=None, seq=0):
    before = 11 - version if before is None else before
    after = before - 1 if after is None else after
    hop = kind != "inventory_item"
    return R.Record("g", seq, key, event, tenant, kind, item, version, None if hop else before, None if hop else after, parent, order, hash_ or event)


def states(records):
    group = R.Group()
    for k, r in enumerate(records):
        list(group.deliver(r._replace(seq=k)))
    return {e: s for e, (s, _) in group.inbox.items()}, group


def test_duplicate_conflict_gap_stale_transition():
    one, two, three = record("a", 1), record("b", 2), record("c", 3)
    assert states([one, one])[0] == {"a": "duplicate_noop"}
    done, group = states([one, record("a", 1, hash_="other")])
    assert done == {"a": "quarantined_conflict"} and list(group.items.values()) == [[9, 1]]
    assert states([two, one])[0] == {"a": "applied", "b": "applied"}
    done, group = states([three, one])
    assert done == {"c": "quarantined_gap", "a": "applied"}
    assert states([one, two, record("x", 1)])[0]["x"] == "quarantined_stale"
    assert states([one, record("x", 2, before=5)])[0]["x"] == "quarantined_transition"
    assert states([record("a", 1, key="t1/inventory_item/other")])[0]["a"] == "quarantined_mismatch"
    assert states([two, record("b", 2, hash_="other"), one])[0] == {"b": "quarantined_conflict", "a": "applied"}


def test_any_order_ends_alike():
    records = [record(str(v), v) for v in range(1, 9)]
    for seed in range(20):
        random.Random(seed).shuffle(mixed := list(records))
        done, group = states(mixed)
        assert set(done.values()) == {"applied"} and list(group.items.values()) == [[2, 8]]


def test_hops_are_unique_and_not_taken_up_again():
    lot = lambda e, i, p, v=1: record(e, v, item=i, kind="ingredient_lot", parent=p)
    done, _ = states([lot("a", "l1", "s1"), lot("b", "l2", "s1"), lot("c", "l3", "s2"), lot("d", "l1", "s9", 2), lot("e", "l4", "s4", 2), lot("f", "l4", "s4")])
    assert done == {"a": "applied", "b": "quarantined_invalid", "c": "applied", "d": "quarantined_invalid", "e": "quarantined_gap", "f": "applied"}


def test_events_waiting_for_one_version_are_all_kept():
    x, y = record("x", 2, before=5), record("y", 2)
    done, group = states([x, y, record("a", 1), record("a", 1)])
    assert done == {"x": "quarantined_transition", "y": "applied", "a": "duplicate_noop"} and list(group.items.values()) == [[8, 2]]


def frame(spark, records):
    return spark.createDataFrame([tuple(r._replace(seq=k)) for k, r in enumerate(records)], R.RECORD)


def test_batch_fold_trace_and_rebuild(spark):
    records = [
        record("s", 1, kind="supplier", item="s1"), record("sh", 1, kind="shipment", item="h1", parent="b1", order="o1"), record("b", 1, kind="production_batch", item="b1", parent="l1"),
        record("l", 1, kind="ingredient_lot", item="l1", parent="s1"), record("other", 1, kind="shipment", item="h9", parent="b1", order="o9", tenant="t2"), record("v2", 2), record("v1", 1),
    ]
    rows = R.with_groups(frame(spark, records))
    changes = R.fold(rows).cache()
    traced = R.trace(R.hops(changes), spark.createDataFrame([("t1", "b1"), ("t2", "b1")], "tenant_id string, batch_id string")).collect()
    found = {r["tenant_id"]: r for r in traced}
    assert (found["t1"]["lot_id"], found["t1"]["supplier_known"], found["t1"]["shipment_id"]) == ("l1", True, "h1") and found["t2"]["lot_id"] is None
    projection, status = replay.rebuild(frame(spark, records), "t1")
    assert status.first()["status"] == "complete" and replay.compare(R.inventory(changes), projection).count() == 0
    assert replay.inventory_checksum(projection).first() == replay.inventory_checksum(R.inventory(changes)).first()
    assert replay.rebuild(frame(spark, [record("v3", 3)]), "t1")[1].first()["status"] == "incomplete"
    counts = replay.rebuild(frame(spark, [record("v1", 1), record("v1", 1)]), "t1")[1].first()
    assert (counts["applied"], counts["duplicate_noop"], counts["records"], counts["status"]) == (1, 1, 2, "complete")
    with pytest.raises(ValueError, match="tenant"):
        replay.scoped(rows, " ")


def test_an_event_id_under_two_aggregates_conflicts(spark):
    rows = R.with_groups(frame(spark, [record("a", 1, item="x"), record("a", 1, item="y", hash_="other"), record("b", 1, item="z")]))
    assert {r["event_id"]: r["disposition"] for r in R.inbox(R.fold(rows)).collect()} == {"a": "quarantined_conflict", "b": "applied"}


def test_queue(spark):
    rows = spark.createDataFrame(
        [(1, "pending", 0, None, None), (2, "publishing", 3, "relay", 100), (3, "publishing", 1, "other", 5), (4, "published", 1, None, None), (5, "publishing", 2, "relay", 100)], "id long, status string, attempts long, lease_owner string, lease long"
    ).select("id", "status", "attempts", "lease_owner", F.timestamp_seconds("lease").alias("lease_expires_at"), F.lit(None).cast("string").alias("last_error_code"), F.timestamp_seconds("id").alias("created_at"))
    now = F.timestamp_seconds(F.lit(10))
    assert [r["id"] for r in outbox.claim(rows, now, 9, "created_at", "id").collect()] == [1, 3]
    outcomes = spark.createDataFrame([(2, "transient", "timeout"), (3, "published", None), (5, "unsupported_contract", None)], "id long, outcome string, code string")
    after = {r["id"]: r for r in outbox.finish(rows, outcomes, "id", now).collect()}
    assert after[2]["status"] == "pending" and after[2]["lease_expires_at"].timestamp() == 14 and after[2]["last_error_code"] == "timeout"
    assert after[3]["status"] == "publishing" and after[5]["status"] == "quarantined" and after[1]["status"] == "pending"
    freed = {r["id"]: r["status"] for r in outbox.release(outbox.finish(rows, outcomes, "id", now), F.col("id") == 5).collect()}
    assert freed[5] == "pending"
    seconds = [r[0] for r in spark.range(0, 9).select(outbox.backoff_seconds(F.col("id"))).collect()]
    assert seconds == [1, 1, 2, 4, 8, 16, 32, 60, 60]


def test_access(spark):
    rows = spark.createDataFrame([("p", "tenant-1", "ops_reader"), ("q", "tenant-1", "ops_reader"), ("q", "", "ops_reader"), ("r", "tenant-2", "ops_reader"), ("s", "tenant-1", "")], "principal_id string, tenant_id string, role_id string")
    asked = spark.createDataFrame([(p, t, "audit" if p == "x" else "inventory_projection", "read") for p, t in (("p", "tenant-1"), ("q", "tenant-1"), ("r", "tenant-2"), ("s", "tenant-1"), ("x", "tenant-1"))], "principal_id string, tenant_id string, resource string, action string")
    assert {r["principal_id"] for r in access.decide(spark, asked, rows).where("outcome = 'allow'").collect()} == {"p"}
    with pytest.raises(ValueError, match="tenant"):
        access.decisions_of(asked, "")


def test_prediction_persistence(spark):
    kind = "prediction_id string, score double, correlation_id string, recorded_at string"
    stored = spark.createDataFrame([("a", 0.5, "x", "1"), ("b", 0.5, "x", "1")], kind)
    new = spark.createDataFrame([("a", 0.5, "y", "2"), ("b", 0.6, "x", "1"), ("c", 0.1, "x", "1")], kind)
    assert {r["prediction_id"]: r["effect"] for r in P.persist(stored, new).collect()} == {"a": "keep", "b": "conflict", "c": "append"}


def test_a_checksum_holds_no_group_as_one_array(spark):
    rows = spark.range(20000).selectExpr("id % 2 AS g", "id", "repeat('x', 200) AS t").repartition(3)
    found = ordered_hash(rows, ["g"], line("id", "t"), "id")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = {g: hashlib.sha256("".join(f"{k}\t{'x' * 200}\n" for k in range(g, 20000, 2)).encode()).hexdigest() for g in (0, 1)}
    assert {r["g"]: r["checksum"] for r in found.collect()} == want


def test_keyed_log_and_point_reads(spark, tmp_path):
    rows = frame(spark, [record(f"{i}-{v}", v, item=f"i{i}") for i in range(20) for v in (2, 1, 3)])
    reads.write_keyed(rows, str(tmp_path / "log"), 4)
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 60 and back.groupBy("key").agg(F.count_distinct("partition").alias("n")).where("n > 1").count() == 0
    assert reads.point(rows, "t1", aggregate_id="i3", version=2).first()["event_id"] == "3-2" and reads.point(rows, "t2", version=1).count() == 0
    snapshot = reads.insufficient_snapshot(spark, dict.fromkeys(("contract", "tenant", "dataset", "features", "history", "projection", "max_recorded_at", "cutoff", "applied"), "x"), "odd", (" b", "a", "a"))
    assert snapshot.count() == 1 and snapshot.first()["status"] == "incomplete"


def test_records_and_their_rules(spark):
    good = ("id1", "t", "i", "stock", "2024-01-05", "2024-01-05", 7, "candidate", "predicted", 0.5, 0.4, 0.6, None)
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(names, good, strict=True))
    names = "prediction_id tenant_id item_id target observation_date source_cutoff_date horizon_days predictor status score lower upper abstention_reason".split()
    rows = [good, change(prediction_id="b", item_id=" "), change(prediction_id="c", observation_date="2024-13-01"), change(prediction_id="d", score=float("nan")), change(prediction_id="e", status="abstained"), change(prediction_id="f", source_cutoff_date="2024-01-06"), change(prediction_id="g", lower=0.55)]
    schema = ", ".join(f"{n} {'int' if n == 'horizon_days' else 'double' if n in ('score', 'lower', 'upper') else 'string'}" for n in names)
    found = validation.record_problems(spark.createDataFrame(rows, schema), "stock", F.col("prediction_id")).collect()
    assert {r["prediction_id"]: r["problem"] for r in found} == {"b": "identity or target", "c": "observation date", "d": "score", "e": "abstained state", "f": "source cutoff", "g": "uncertainty bounds"}
