"""The fold of delivered records into inbox states and the inventory and lineage projections.

``Group`` is the state of one group of aggregates and ``deliver`` its only transition. The batch fold gives each
group its records in order of arrival; the streaming fold keeps it as state (``streaming.raw``). Both run the same code, so a
stream ends where a batch does.

A group is an aggregate for inventory. Lineage hops have keys that are unique over a tenant; in a batch they need no
group (``lineage``), as state they are one for a tenant and kind. Records with one event_id under several groups are
brought into one group first (``with_groups``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stream import map_stream
from eventfold.operators.lineage import fold_hops
from eventfold.sources.tables import written

RECORD = "group string, seq long, log_key string, event_id string, tenant_id string, aggregate_type string, aggregate_id string, version long, before long, after long, parent_id string, order_id string, content_hash string"
CHANGES = "group string, seq long, event_id string, disposition string, tenant_id string, aggregate_type string, aggregate_id string, quantity long, version long, parent_id string, order_id string, expected_version long, received_version long, own boolean"
TERMINAL = ("quarantined_conflict", "quarantined_mismatch", "quarantined_stale", "quarantined_transition", "quarantined_invalid")


class Record(NamedTuple):
    group: str
    seq: int
    log_key: str | None
    event_id: str
    tenant_id: str
    aggregate_type: str
    aggregate_id: str
    version: int
    before: int | None
    after: int | None
    parent_id: str | None
    order_id: str | None
    content_hash: str


class Group:
    def __init__(self) -> None:
        self.inbox: dict[str, list] = {}  # event_id: [state, hash]
        self.items: dict[str, list] = {}  # aggregate key: [quantity, version] or for a hop [version, event_id]
        self.waiting: dict[tuple, list[Record]] = {}  # (aggregate key, version): records in order of arrival
        self.edges: dict[tuple, bool] = {}

    def load(self, r: Record, disposition: str) -> None:
        """State that is there before any delivery: an inbox row with its record, or an aggregate's ``projection``."""
        key = f"{r.tenant_id}/{r.aggregate_type}/{r.aggregate_id}"
        if disposition == "projection":
            self.items[key] = [r.after, r.version] if r.aggregate_type == "inventory_item" else [r.version, r.event_id]
            self._take(r)
            return
        self.inbox[r.event_id] = [disposition, r.content_hash]
        if disposition == "quarantined_gap" and r.aggregate_type == "inventory_item":
            self.waiting[key, r.version] = sorted([*(self.waiting.get((key, r.version)) or []), r], key=lambda held: held.seq)

    def _take(self, r: Record) -> None:
        for edge in self._edges(r):
            self.edges[edge] = True

    def deliver(self, r: Record) -> Iterator[tuple]:
        """What a record changes: rows of ``CHANGES``, the last state of an event or aggregate winning. The first is the
        record's own result, those of waiting records that it lets in follow."""
        key = f"{r.tenant_id}/{r.aggregate_type}/{r.aggregate_id}"
        if r.log_key is not None and r.log_key != key:
            self.inbox[r.event_id] = ["quarantined_mismatch", r.content_hash]
            yield self._change(r, "quarantined_mismatch")
            return
        seen = self.inbox.get(r.event_id)
        if seen and seen[1] != r.content_hash:
            self.inbox[r.event_id] = ["quarantined_conflict", seen[1]]  # terminal: if it waits, it is not taken up again
            yield self._change(r, "quarantined_conflict")
            return
        if seen and seen[0] in ("applied", "duplicate_noop"):
            self.inbox[r.event_id] = ["duplicate_noop", seen[1]]
            yield self._change(r, "duplicate_noop")
            yield from self._drain(key, r)
        elif seen and seen[0] in TERMINAL:
            yield self._change(r, seen[0])
        else:
            change = self._apply(key, r)
            self.inbox[r.event_id] = [change[3], r.content_hash]
            yield change
            if change[3] == "applied":
                yield from self._drain(key, r)

    def _apply(self, key: str, r: Record) -> tuple:
        if r.aggregate_type != "inventory_item":
            return self._apply_hop(key, r)
        now = self.items.get(key)
        expected = now[1] + 1 if now else 1
        if r.version > expected:
            held = self.waiting.get((key, r.version)) or []
            if all(w.event_id != r.event_id for w in held):
                self.waiting[key, r.version] = [*held, r]
            return self._change(r, "quarantined_gap", expected)
        if r.version < expected:
            return self._change(r, "quarantined_stale", expected)
        if now and r.before != now[0]:
            return self._change(r, "quarantined_transition")
        self.items[key] = [r.after, r.version]
        return self._change(r, "applied", quantity=r.after)

    def _apply_hop(self, key: str, r: Record) -> tuple:
        """Hops are inserted once and never updated; a lost unique edge makes them invalid. Their gaps stay."""
        now = self.items.get(key)
        if now and r.version <= now[0]:
            return self._change(r, "duplicate_noop" if now[1] == r.event_id else "quarantined_stale", now[0] + 1)
        if now and r.version == now[0] + 1:
            return self._change(r, "quarantined_invalid")
        if r.version != 1:
            return self._change(r, "quarantined_gap", now[0] + 1 if now else 1)
        if any(self.edges.get(edge) for edge in self._edges(r)):
            return self._change(r, "quarantined_invalid")
        self._take(r)
        self.items[key] = [1, r.event_id]
        return self._change(r, "applied")

    @staticmethod
    def _edges(r: Record) -> set[tuple]:
        return {(r.tenant_id, r.aggregate_type, what, value) for what, value in (("parent", r.parent_id), ("order", r.order_id)) if value is not None}

    def _drain(self, key: str, after: Record) -> Iterator[tuple]:
        """Waiting versions that have become next, lowest first. Of several records of a version the first to arrive is
        tried; the others keep waiting, for the next record that is applied or a duplicate."""
        if after.aggregate_type != "inventory_item":
            return
        while (now := self.items.get(key)) and (held := self.waiting.get(at := (key, now[1] + 1))):
            r, *rest = held
            if rest:
                self.waiting[at] = rest
            else:
                del self.waiting[at]
            state = self.inbox.get(r.event_id)
            if state[0] != "quarantined_gap":
                continue
            change = self._apply(key, r)
            self.inbox[r.event_id] = [change[3], state[1]]
            yield change[0], after.seq, *change[2:-1], False
            if change[3] != "applied":
                return

    def _change(self, r: Record, disposition: str, expected: int | None = None, quantity: int | None = None) -> tuple:
        return r.group, r.seq, r.event_id, disposition, r.tenant_id, r.aggregate_type, r.aggregate_id, quantity, r.version, r.parent_id, r.order_id, expected, r.version if expected is not None else None, True


def columns(rows: DataFrame) -> DataFrame:
    return rows.select(*(c.split()[0] for c in RECORD.split(", ")))


def with_groups(rows: DataFrame) -> DataFrame:
    """``rows`` with ``group``; groups that share an event_id become one, named by the smallest.

    Shared ids are rare, so the loop runs over them alone, and mostly finds none.
    """
    hop = F.concat_ws("/", "tenant_id", "aggregate_type")
    own = F.when(F.col("aggregate_type") == "inventory_item", F.concat_ws("/", "tenant_id", "aggregate_type", "aggregate_id")).otherwise(hop)
    rows = rows.withColumn("group", own)
    many = rows.groupBy("event_id").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("event_id")
    many = written(many, "shared-ids")
    shared = written(rows.select("event_id", "group").join(many, "event_id", "left_semi").distinct().withColumn("to", F.col("group")), "shared")
    changed = shared.limit(1).count()
    while changed:
        least = shared.groupBy("event_id").agg(F.min("to").alias("low"))
        by_group = shared.join(least, "event_id").groupBy("group").agg(F.min("low").alias("new"))
        after = shared.join(by_group, "group").select("event_id", "group", F.col("to").alias("was"), F.col("new").alias("to"))
        shared = written(after, "shared")
        changed = shared.where("to <> was").limit(1).count()
    names = shared.select("group", "to").distinct()
    return rows.join(names, "group", "left").withColumn("group", F.coalesce("to", "group")).drop("to")


def _by_group(rows: DataFrame) -> DataFrame:
    """Each group's records as a stream in order of arrival: a task holds one group's state, and no frame of its records."""

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        for _, own in groupby(stream, lambda r: r[0]):
            group = Group()
            for r in own:
                yield from group.deliver(Record._make(r))

    return map_stream(columns(rows).repartition("group").sortWithinPartitions("group", "seq"), CHANGES, run)


def fold(rows: DataFrame) -> DataFrame:
    """The change-log of records (columns of ``RECORD``), in the order of ``seq``: inventory by group, events whose first
    delivery is a hop by their unique keys."""
    rows = columns(rows)
    hop = rows.where("aggregate_type <> 'inventory_item'")
    if not hop.limit(1).count():
        return _by_group(rows)
    first = rows.join(hop.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.min_by("aggregate_type", "seq").alias("kind"))
    ids = written(first.where("kind <> 'inventory_item'").select("event_id"), "hop-events")
    folded = fold_hops(rows.join(ids, "event_id", "left_semi"))
    nothing = F.lit(None).cast("long").alias("quantity")
    changes = folded.select("group", "seq", "event_id", "disposition", "tenant_id", "aggregate_type", "aggregate_id", nothing, "version", "parent_id", "order_id", "expected_version", "received_version", F.lit(True).alias("own"))
    return _by_group(columns(rows.join(ids, "event_id", "left_anti"))).unionByName(changes)


def inbox(changes: DataFrame) -> DataFrame:
    """Each event's last state."""
    last = F.max_by(F.struct("disposition", "expected_version", "received_version"), F.struct("seq", F.when(F.col("disposition") == "quarantined_gap", 0).otherwise(1)))
    return changes.groupBy("event_id").agg(last.alias("l")).select("event_id", "l.*")


def inventory(changes: DataFrame) -> DataFrame:
    """The projection: each item's quantity after its last applied version."""
    ok = changes.where("disposition = 'applied' AND aggregate_type = 'inventory_item'")
    return ok.groupBy("tenant_id", F.col("aggregate_id").alias("item_id")).agg(F.max_by("quantity", "version").alias("quantity_on_hand"), F.max("version").alias("aggregate_version"))


def hops(changes: DataFrame) -> DataFrame:
    """The lineage projection: applied hops of all kinds."""
    return changes.where("disposition = 'applied' AND aggregate_type <> 'inventory_item'").select("tenant_id", "aggregate_type", "aggregate_id", "parent_id", "order_id", "version", "event_id")


def trace(rows: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """Batches (tenant_id, batch_id) with their lot, its supplier, and their shipment; missing hops are null.

    The tenant is part of every join condition.
    """
    kind = lambda name, *c: rows.where(F.col("aggregate_type") == name).select("tenant_id", *c)
    id_, parent = F.col("aggregate_id"), F.col("parent_id")
    out = batch_ids.join(kind("production_batch", id_.alias("batch_id"), parent.alias("lot_id")), ["tenant_id", "batch_id"], "left")
    out = out.join(kind("ingredient_lot", id_.alias("lot_id"), parent.alias("supplier_id")), ["tenant_id", "lot_id"], "left")
    out = out.join(kind("supplier", id_.alias("supplier_id"), F.lit(True).alias("supplier_known")), ["tenant_id", "supplier_id"], "left")
    out = out.join(kind("shipment", parent.alias("batch_id"), id_.alias("shipment_id"), "order_id"), ["tenant_id", "batch_id"], "left")
    return out.select("tenant_id", "batch_id", "lot_id", "supplier_id", F.coalesce("supplier_known", F.lit(False)).alias("supplier_known"), "shipment_id", "order_id")
