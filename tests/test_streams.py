"""The raw stream, its commits and its start from stored state; stores by batch; strict documents; numbers in order."""

import json

import pytest
from pyspark.sql import functions as F

from eventfold.functions import canon
from eventfold.functions.ordered import numbered
from eventfold.operators import artifacts as Z
from eventfold.operators import fold as R
from eventfold.operators import process as N
from eventfold.operators import reads
from eventfold.operators import source as S
from eventfold.streaming import raw as W
from eventfold.streaming.log import read_log
from eventfold.streaming.store import Feed, PredictionStore

LOG = "topic string, partition int, offset long, key binary, value binary, arrival long, error string"
UUID = "00000000-0000-4000-8000-%012d"


def event(n, item, version, before, dec=1):
    return {
        "event_id": UUID % n, "tenant_id": UUID % 1, "event_type": "inventory.quantity_decremented", "event_schema_version": 1, "aggregate_type": "inventory_item", "aggregate_id": item, "aggregate_version": version,
        "occurred_at": "2024-01-01T00:00:00Z", "recorded_at": "2024-01-01T00:00:00Z", "producer": canon.PRODUCER, "correlation_id": UUID % 7, "causation_id": None, "trace_id": "t",
        "payload": {"order_id": UUID % n, "item_id": item, "quantity_decremented": dec, "quantity_before": before, "quantity_after": before - dec},
    }


def row(offset, value, error=None, item="flour"):
    raw = value if isinstance(value, bytes) else json.dumps(value).encode()
    return ("events", offset % 2, offset, bytearray(f"{UUID % 1}/inventory_item/{item}".encode()), bytearray(raw), offset, error)


def test_stream_stops_and_goes_on_as_the_batch_does(spark, tmp_path):
    W.with_rocksdb(spark)
    one, two, three = event(11, "flour", 1, 9), event(12, "flour", 2, 8), event(13, "flour", 3, 7)
    first = [row(0, three), row(1, one), row(2, b"{"), row(3, b'{"event_id":"x"} tail'), row(4, two, "handler")]
    then = [row(5, two), row(2, b"{"), *[row(4, two, "handler")] * 4, row(7, one), row(8, {**one, "trace_id": "other"})]
    for rows in (first, then):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        log = read_log(spark, f"{tmp_path}/log", LOG)
        found = W.run(W.results(W.prepared(log, F.col("arrival"), F.col("error"))), W.RESULTS, f"{tmp_path}/results", f"{tmp_path}/checkpoint")
        results = spark.readStream.schema(W.RESULTS).parquet(f"{tmp_path}/results")
        told = W.committed(W.run(W.commits(results), W.COMMITS, f"{tmp_path}/commits", f"{tmp_path}/checkpoint-commits"))
        ends = {r["partition"]: (r["committed"], r["open"]) for r in told.collect()}
        assert ends == ({0: (4, 1), 1: (4, 0)} if rows is first else {0: (9, 0), 1: (8, 0)})
    states = {r["event_id"]: r["disposition"] for r in R.inbox(found.where("disposition IS NOT NULL")).collect()}
    assert states == {UUID % 11: "quarantined_conflict", UUID % 12: "applied", UUID % 13: "applied"}
    failed = {r["offset"]: r for r in W.failures(found).collect()}
    assert {k: (r["attempt_count"], r["failure_category"], r["quarantine_status"]) for k, r in failed.items()} == {2: (2, "malformed", "quarantined"), 3: (1, "malformed", "quarantined"), 4: (5, "poison", "quarantined")}
    assert failed[4]["event_id"] == UUID % 12 and failed[3]["event_id"] is None
    batch = spark.createDataFrame([r for r in [*first, *then] if r[-1] is None], LOG)
    failures, changes = N.process(batch.drop("error"), F.col("arrival"))
    assert {r["offset"]: r["attempt_count"] for r in failures.collect()} == {2: 2, 3: 1}
    assert {r["event_id"]: r["disposition"] for r in R.inbox(changes).collect()} == states


def test_stream_from_stored_state(spark, tmp_path):
    W.with_rocksdb(spark)
    group = "t/inventory_item/flour"
    record = lambda e, v, before, what: (group, v, None, e, "t", "inventory_item", "flour", v, before, before - 1, None, None, e, what)
    stored = spark.createDataFrame([record("a", 1, 9, "applied"), record("a", 1, 9, "projection"), record("c", 3, 7, "quarantined_gap")], S.STATE)
    fresh = [record(e, v, before, "")[:-1] + ("history", 1, v, *[None] * 5) for e, v, before in (("a", 1, 9), ("b", 2, 8))]
    spark.createDataFrame(fresh, W.INPUT).write.parquet(f"{tmp_path}/log")
    found = W.run(W.results(read_log(spark, f"{tmp_path}/log", W.INPUT), stored), W.RESULTS, f"{tmp_path}/results", f"{tmp_path}/checkpoint")
    assert {r["event_id"]: r["disposition"] for r in R.inbox(found).collect()} == {"a": "duplicate_noop", "b": "applied", "c": "applied"}


@pytest.mark.parametrize(("raw", "want"), [
    (b'{"event_id":"x","aggregate_version":3} tail', {}), (b'{"event_id":"x","aggregate_version":"5"}', {}), (b'{"event_id":7}', {}), (b'{"event_id":" x "}', {"event_id": " x "}), (b'{"event_id":"","tenant_id":null,"aggregate_version":0}', {}),
    (b'{"EVENT_ID":"x","event_id":"y","event_schema_version":2,"payload":[1.5,true]}', {"event_id": "y", "event_schema_version": 2}), (b'{"aggregate_version":1.0}', {}), (b'{"aggregate_version":99999999999999999999}', {}), (b"[]", {}), (b"{", {}), (b"\xff", {}),
    (b'{"event_id":"x","event_id":null,"aggregate_type":"k"}', {"event_id": "x", "aggregate_type": "k"}), (b'{"aggregate_version":true}', {}), (b'{"event_id":NaN}', {}),
])
def test_identity_of_rejected_values(raw, want):
    assert {k: v for k, v in canon.identity(raw).items() if v is not None} == want


def test_strict_documents_and_responses(spark):
    shape = {"a": "string", "n": "integer", "x": "number", "deep": {"list": [{"b": "integer"}]}}
    cases = {
        '{"a":"x","n":1,"x":0.5,"deep":{"list":[{"b":1},{}]}}': None, '{}': None, '{"a":null,"deep":null}': None, '{"a":"x"} tail': "not one JSON document", '{"a":"x"}{"a":"y"}': "not one JSON document", '{"a":"x"},{}': "not one JSON document", '{"a":"x"}] [': "not one JSON document",
        '{"a":{}} {"v":1': "not one JSON document", "": "not one JSON document", "[1]": "document: not an object", '{"more":1}': "document: unknown member more", '{"n":1.0}': "n: not an integer", '{"n":1e2}': "n: not an integer", '{"x":"1"}': "x: not a number", '{"x":3}': None,
        '{"deep":{"list":[{"b":1},{"b":"1"}]}}': "deep.list[].b: not an integer", '{"deep":{"list":[{"c":1}]}}': "deep.list[]: unknown member c", '{"deep":{"list":{}}}': "deep.list: not an array", '{"a":5}': "a: not a string", '{"a":"x","a":"y"}': "not one JSON document",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "value string")
    assert {r["value"]: r["problem"] for r in Z.strict(rows, shape).collect()} == cases
    base = {"contract_version": 1, "predictor": "candidate", "row_id": "r", "observation_date": "2024-01-01", "source_cutoff_date": "2024-01-01", "status": "predicted", "stockout_risk": 0.5, "uncertainty": {"method": "m", "lower": 0.25, "upper": 0.75, "sample_count": 9}}
    said = [
        (base, None), ({**base, "row_id": "other"}, "response lineage"), ({**base, "source_cutoff_date": "2024-01-02"}, "response lineage"), ({**base, "stockout_risk": 1.5}, "score"), ({**base, "uncertainty": None}, "predicted response"), ({**base, "stockout_risk": 0.9}, "uncertainty bounds"),
        ({**base, "status": "abstained"}, "abstained response"), ({**base, "status": "abstained", "stockout_risk": None, "uncertainty": None, "abstention_reason": "insufficient_support"}, None), ({**base, "status": "other"}, "response status"), ({**base, "more": 1}, "document: unknown member more"),
    ]
    asked = ("contract_version", "predictor", "row_id", "observation_date")
    found = Z.strict(spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(said)], "k long, value string"), Z.RESPONSE)
    for name in asked:
        found = found.withColumn(f"request_{name}", F.lit(base[name]))
    assert [r["p"] for r in found.select("k", Z.response_problem(asked).alias("p")).orderBy("k").collect()] == [p for _, p in said]


def test_assignment_lists_fail_as_a_whole(spark):
    found = reads.assignments(spark.createDataFrame([("a|t|r, b | t | r ",), ("c|t|r,d|t",), ("e||r",), (" ",), (None,), ("f|t|r,",)], "value string")).collect()
    assert sorted((r["principal_id"] or "", r["problem"] or "") for r in found) == [("", "assignment contains an empty field"), ("", "assignment must be principal|tenant|role"), ("", "assignment must be principal|tenant|role"), ("a", ""), ("b", "")]


def test_numbers_in_order_need_no_window_over_a_tenant(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 < 9, "b").alias("tenant"), (F.col("id") * 7919 % 3001).alias("place"), "id").repartition(5)
    found = numbered(rows, ["tenant"], ["place"], "offset")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["tenant"] or "", r["place"])):
        want.setdefault(r["tenant"], []).append(r["id"])
    assert {(r["tenant"], r["offset"]): r["id"] for r in found.collect()} == {(t, k): i for t, ids in want.items() for k, i in enumerate(ids, 1)}
    assert numbered(rows.where("false"), ["tenant"], ["place"], "offset").count() == 0


def test_a_batch_again_changes_nothing(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "prediction_id long, tenant_id string, item_id string, observation_date string, recorded_at string, score double")
    store = PredictionStore(spark, f"{tmp_path}/store", "prediction_id long, tenant_id string, item_id string, observation_date string, recorded_at string, score double", buckets=4)
    one, same, other = (1, "t", "i", "d1", "now", 0.5), (1, "t", "i", "d1", "later", 0.5), (1, "t", "i", "d1", "now", 0.6)
    effects = lambda df: sorted(map(tuple, df.collect()))
    assert effects(store.insert(rows(one), 0)) == [(1, "append")]
    assert effects(store.insert(rows(same, (2, "t", "i", "d2", "now", 0.1)), 1)) == [(1, "keep"), (2, "append")]
    assert effects(store.insert(rows(other, (2, "t", "i", "d2", "now", 0.1)), 2)) == [(1, "conflict"), (2, "keep")]
    before = sorted(map(tuple, store.rows().collect()))
    assert effects(store.insert(rows(same, (2, "t", "i", "d2", "now", 0.1)), 1)) == [(1, "keep"), (2, "append")]
    assert sorted(map(tuple, store.rows().collect())) == before and len(before) == 2
    assert store.read("t", 1).first()["score"] == 0.5 and store.read("other", 1).count() == 0 and store.latest().first()["prediction_id"] == 2
    assert effects(store.insert(rows().where("false"), 3)) == []
    feed = Feed(spark, f"{tmp_path}/feed", "id long")
    change = lambda *x: spark.createDataFrame(list(x), "tenant_id string, id long")
    for batch, found in ((0, change(("t", 1), ("u", 2))), (1, change(("t", 3), (None, 4))), (1, change(("t", 3), (None, 4)))):
        feed.publish("q", found, batch)
    seen = feed.after("t")
    assert sorted(r["id"] for r in seen.collect()) == [1, 3] and feed.cursor(seen) == {"q": 1}
    feed.publish("q", change(("t", 5)), 2)
    assert [r["id"] for r in feed.after("t", {"q": 1}).collect()] == [5] and [r["id"] for r in feed.after("u").collect()] == [2]


def test_forecast_source_of_odd_tenants(spark):
    cutoff = F.lit("2024-01-10 00:00:00").cast("timestamp")
    outbox = "event_id string, tenant_id string, item_id string, version long, content_hash string, status string, recorded_at string, before long, dec long, after long"
    retained = [("a", "t", "x", 1, "H", "published", "2024-01-01 00:00:00", 9, 1, 8), ("a", "t", "x", 1, "H", "published", "2024-01-02 00:00:00", 9, 1, 8), ("b", "u", "y", 1, "h", "pending", "2024-01-03 00:00:00", 5, 1, 4), ("late", "t", "x", 2, "h", "published", "2024-02-01 00:00:00", 8, 1, 7)]
    rows = spark.createDataFrame(retained, outbox).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    inbox = spark.createDataFrame([("a", "t", "x", 1, "h", "applied")], "event_id string, tenant_id string, item_id string, version long, content_hash string, disposition string")
    projection = spark.createDataFrame([("t", "x", 8, 1), ("w", "z", 1, 1)], "tenant_id string, item_id string, quantity_on_hand long, aggregate_version long")
    found = {r["tenant_id"]: r for r in S.forecast_source(rows, inbox, projection, cutoff).collect()}
    assert found["t"]["status_reasons"] == ["incomplete:duplicate retained event a"] and found["t"]["applied_event_count"] == 1 and str(found["t"]["source_cutoff_date"]) == "2024-01-01"
    assert (found["u"]["status"], found["u"]["status_reasons"]) == ("stale", ["stale:inventory event not applied b"])
    assert found["w"]["status_reasons"] == ["incomplete:projection item missing retained history z"] and found["w"]["max_recorded_at"] is None
    told = reads.checkpoint_probe({"outbox": rows.select("tenant_id", "event_id", F.col("status").alias("state")), "inbox": inbox.select("tenant_id", "event_id", F.col("disposition").alias("state"))})
    assert {r["event_id"]: (r["outbox"], r["inbox"], r["n_stores"]) for r in told.collect()}["a"] == ("published", "applied", 2)


class Held:
    """A map of the state store, as its client gives it."""

    def __init__(self):
        self.held, self.trips = {}, 0

    def getValue(self, key):  # noqa: N802
        self.trips += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.trips += 1
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.held[key]

    def keys(self):
        return iter(list(self.held))


def test_state_is_met_in_chunks_and_not_by_entries():
    state, want = Held(), {}
    for batch in range(40):
        chunks = W.Chunks(state)
        inbox = W.Entries(chunks, "inbox")
        before, state.trips = state.trips, 0
        for k in range(batch * 50, batch * 50 + 50):
            want[f"e{k}"] = inbox[f"e{k}"] = ["applied", str(k)]
        if batch:
            del inbox[f"e{batch}"]
            want.pop(f"e{batch}")
        chunks.write_back()
        assert batch > 0 or state.trips <= 2
    chunks = W.Chunks(state)
    assert {k: W.Entries(chunks, "inbox").get(k) for k in map("e{}".format, range(2000)) if W.Entries(chunks, "inbox").get(k)} == want
    assert chunks.size == len(want) and chunks.parts == 32 and len(state.held) == 32
    assert max(len(x[0]) for x in state.held.values()) < sum(len(x[0]) for x in state.held.values()) / 8


def test_commits_take_a_batch_in_any_order():
    class End:
        def exists(self):
            return False

        def update(self, value):
            self.value = value

    own = W.CommitProcessor()
    own.open, own.end = Held(), End()
    rows = [{"offset": 4, "attempt_count": n, "acknowledged": n == 5} for n in (5, 3, 1, 4, 2)] + [{"offset": 6, "attempt_count": 1, "acknowledged": False}, {"offset": 9, "attempt_count": None, "acknowledged": True}]
    (told,) = own.handleInputRows(("events", 0), iter(rows), None)
    assert (told["committed"], told["open"], told["seen"]) == (6, 1, 9) and list(own.open.held) == [(6,)]


@pytest.mark.parametrize("change", [
    lambda t: t.replace('"trace_id":"t"', '"trace_id":"t","trace_id":"t"'), lambda t: t.replace('"trace_id":"t"', '"trace_id":"t","x":1'), lambda t: t.replace(':1,"occurred', ':-0,"occurred'), lambda t: t.replace(':1,"occurred', ':true,"occurred'), lambda t: t + " ", lambda t: t + "{}",
    lambda t: t.replace('"trace_id":"t"', '"trace_id":"\\u0074"'), lambda t: t.replace('"trace_id":"t"', '"trace_id":"\\ud800"'), lambda t: t.replace(':1,"occurred', ':9007199254740992,"occurred'), lambda t: t.replace(':1,"occurred', ':1.0,"occurred'),
])
def test_the_short_way_accepts_only_what_the_strict_parser_does(change):
    text = json.dumps(event(11, "flour", 1, 9), separators=(",", ":"))
    assert canon._compact(text.encode()) == (json.loads(text), canon.canonical(json.loads(text)))
    assert canon._compact(change(text).encode()) is None or canon.decode(change(text).encode())


def test_groups_are_folded_as_streams(spark):
    rows = spark.createDataFrame([(f"g{k}", 1, None, f"e{k}", "t", "inventory_item", f"i{k}", 1, 9, 8, None, None, "h") for k in range(3)], R.RECORD)
    plan = lambda df: df._jdf.queryExecution().toString()
    state = rows.selectExpr("*", "'applied' AS disposition")
    assert "InPandas" not in plan(R.fold(rows)) + plan(S.replay_onto(state, rows))
    assert sorted(r["disposition"] for r in S.replay_onto(state.where("group = 'g0'"), rows).collect()) == ["applied", "applied", "duplicate_noop"]
