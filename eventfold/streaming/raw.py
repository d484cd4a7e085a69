"""The raw log as one stateful stream: bytes in, dispositions, failures and committed positions out.

``transformWithState`` keeps each aggregate's state as a map in the state store: an event's inbox row, an aggregate's
projection and the records that wait for a version are entries in small chunks, so a delivery reads and writes the chunks it
meets and not a large group's whole state, and a small group is one chunk. The transition is ``fold.Group``, the same as in the batch. A rejected value is a
failure under its position, with its attempts as state; ``SPAN`` positions are one key. Every record gives its position with
its first result. Rows come and go as rows: most keys have few of them in a batch, too few for a pandas frame each.

A second stream over these results keeps, for each partition, the open positions and the end, and tells how far a consumer
may commit. Both streams go on from their checkpoints; the file sink takes each batch once. State of the operator can be
started from a stored inbox and projection (``stored``).

The state store has to be RocksDB (``with_rocksdb``). An event_id under several aggregates is met by each on its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventfold.functions import canon
from eventfold.operators import fold as R
from eventfold.operators.process import IDENTITY, POISON_ATTEMPTS, POSITION

FAILURE = ("failure_category", "diagnostic_code", "received_hash", "event_type", "schema_version")
INPUT = R.RECORD + ", topic string, partition int, offset long, failure_category string, diagnostic_code string, received_hash string, event_type string, schema_version long"
RESULTS = R.CHANGES + ", topic string, partition int, offset long, attempt_count long, failure_category string, diagnostic_code string, received_hash string, event_type string, schema_version long, quarantine_status string, acknowledged boolean"
COMMITS = "topic string, partition int, committed long, open long, seen long, round long"
_NAMES = [c.split()[0] for c in RESULTS.split(", ")]
_RESULT, _COMMIT = Row(*_NAMES), Row(*(c.split()[0] for c in COMMITS.split(", ")))
#: Positions whose failures are kept under one key, and files that a stream takes at a time.
SPAN, FILES = 1 << 12, 64
#: Entries in a chunk of state, about, and numbers of arrival that make one row of stored state.
CHUNK, STORED = 64, 1 << 10


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Chunks:
    """Named entries of one key in a map of the state store, dealt by hash to chunks of about ``CHUNK`` entries.

    Chunks that are met are read once and written back once. Their number doubles as the entries grow, so that a delivery
    reads and writes a chunk, and never a large group's whole state."""

    def __init__(self, state):
        self.state, self.met, self.changed = state, {}, set()
        self.parts, self.size = self._chunk(0).get("", (1, 0))

    def _chunk(self, part: int) -> dict:
        if part not in self.met:
            found = self.state.getValue((part,))
            self.met[part] = {} if found is None else json.loads(found[0])
        return self.met[part]

    def _part(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (self.parts - 1)

    def get(self, name: str):
        return self._chunk(self._part(name)).get(name)

    def put(self, name: str, value) -> None:
        """``value`` under ``name``; None removes it."""
        chunk = self._chunk(part := self._part(name))
        self.size += (value is not None) - (name in chunk)
        if value is None:
            chunk.pop(name, None)
        else:
            chunk[name] = value
        self.changed.add(part)

    def write_back(self) -> None:
        if not self.changed:
            return
        if self.size > CHUNK * self.parts:
            every = {name: x for part in range(self.parts) for name, x in self._chunk(part).items() if name}
            while self.size > CHUNK * self.parts:
                self.parts *= 2
            self.met = {part: {} for part in range(self.parts)}
            for name, x in every.items():
                self.met[self._part(name)][name] = x
            self.changed = set(self.met)
        self.met[0][""] = self.parts, self.size
        for part in self.changed | {0}:
            self.state.updateValue((part,), (json.dumps(self.met[part]),))
        self.changed = set()


class Entries:
    """One kind of entries in ``Chunks`` as the mapping that ``Group`` works on. Values are not changed in place."""

    def __init__(self, chunks: Chunks, kind: str, read=lambda x: x):
        self.chunks, self.kind, self.read = chunks, kind, read

    def _name(self, key) -> str:
        return f"{self.kind}/{key}" if isinstance(key, str) else f"{self.kind}:{json.dumps(key)}"

    def get(self, key):
        found = self.chunks.get(self._name(key))
        return None if found is None else self.read(found)

    __getitem__ = get

    def __setitem__(self, key, value) -> None:
        self.chunks.put(self._name(key), value)

    def __delitem__(self, key) -> None:
        self.chunks.put(self._name(key), None)


class FoldProcessor(StatefulProcessor):
    def __init__(self, poison: int = POISON_ATTEMPTS):
        self.poison = poison

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("entries", "part long", "v string")

    def _group(self) -> tuple[R.Group, Entries, Chunks]:
        group, chunks = R.Group(), Chunks(self.state)
        for what in ("inbox", "items", "waiting", "edges"):
            setattr(group, what, Entries(chunks, what, (lambda held: [R.Record(*r) for r in held]) if what == "waiting" else lambda x: x))
        return group, Entries(chunks, "failure"), chunks

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N803  the interface's names
        group, _, chunks = self._group()
        for r in initialState["rows"]:
            group.load(R.Record(*(r[n] for n in R.Record._fields)), r["disposition"])
        chunks.write_back()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        (group, failures, chunks), n = self._group(), len(R.Record._fields)
        blank = (None,) * (len(_NAMES) - len(R.CHANGES.split(", ")) - len(POSITION) - 1)
        for row in sorted(rows, key=lambda r: r["seq"]):
            if row["failure_category"] is not None:
                told = self._attempt(failures, row)
                yield _RESULT(*(told.get(c) for c in _NAMES))
                continue
            at = tuple(row[c] for c in POSITION)
            for k, change in enumerate(group.deliver(R.Record._make(row[:n]))):
                yield _RESULT(*change, *(at if k == 0 else (None,) * len(at)), *blank, True if k == 0 else None)
        chunks.write_back()

    def _attempt(self, failures: Entries, row: Row) -> dict:
        """A failure's row after one more attempt: identity and hash of the first one, code and category of this one."""
        at = "/".join(str(row[c]) for c in POSITION)
        before = failures.get(at) or {"n": 0, "first": {c: row[c] for c in (*IDENTITY, "received_hash")}, "retried": row["failure_category"] == "poison"}
        before["n"] += 1
        failures[at] = before
        status = "retrying" if before["retried"] and before["n"] < self.poison else "quarantined"
        return {"seq": row["seq"], **before["first"], **{c: row[c] for c in (*POSITION, "failure_category", "diagnostic_code")}, "attempt_count": before["n"], "quarantine_status": status, "acknowledged": status == "quarantined"}

    def close(self) -> None:
        pass


def prepared(log: DataFrame, seq, error=None) -> DataFrame:
    """The stream's input (columns of ``INPUT``) of a log. ``error`` is the code of a handler that failed on a record, or null:
    such a record is an attempt on poison."""
    parsed = canon.parse_log(log, without=("value", "canonical"))
    code = F.lit(None).cast("string") if error is None else error
    poison = F.col("category").isNull() & code.isNotNull()
    rows = parsed.withColumns({
        "seq": seq.cast("long"), "log_key": F.col("key").cast("string"), "failure_category": F.when(poison, "poison").otherwise(F.col("category")), "diagnostic_code": F.when(poison, code).otherwise(F.col("rule")),
    })
    hop = F.concat_ws("/", "tenant_id", "aggregate_type")
    own = F.when(F.col("aggregate_type") == "inventory_item", F.concat_ws("/", "tenant_id", "aggregate_type", "aggregate_id")).otherwise(hop)
    group = F.when(F.col("failure_category").isNotNull(), F.concat_ws("/", F.lit("failure"), "topic", F.col("partition").cast("string"), F.expr(f"cast(offset div {SPAN} AS string)"))).otherwise(own)
    return rows.withColumn("group", group).select(*(c.split()[0] for c in INPUT.split(", ")))


def placed(records: DataFrame) -> DataFrame:
    """The stream's input of records (columns of the fold's ``RECORD``) that come from no log; ``seq`` is their position."""
    places = {"topic": F.lit("history"), "partition": F.lit(1), "offset": F.col("seq")}
    nothing = lambda kind: F.lit(None).cast(kind)
    return records.select(*(places[n].alias(n) if n in places else F.col(n) if n in records.columns else nothing(k).alias(n) for n, k in (c.split() for c in INPUT.split(", "))))


def results(rows: DataFrame, stored: DataFrame | None = None, poison: int = POISON_ATTEMPTS) -> DataFrame:
    """The results of prepared rows as a stream. ``stored``: inbox rows with their record, and of each aggregate a row with
    disposition ``projection`` (columns of ``source.STATE``), from which a new stream starts."""
    started = None
    if stored is not None:
        own = F.array_sort(F.collect_list(F.struct("seq", F.struct(*(c.split()[0] for c in R.RECORD.split(", ")), "disposition").alias("r"))))
        started = stored.groupBy("group", F.expr(f"seq div {STORED}").alias("slice")).agg(F.transform(own, lambda x: x["r"]).alias("rows")).groupBy("group")
    return rows.groupBy("group").transformWithState(FoldProcessor(poison), RESULTS, "Append", "None", initialState=started)


class CommitProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "offset long", "n long")
        self.end = handle.getValueState("end", "seen long, round long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        """A position is as its last result in the batch left it; the batch's rows come in any order."""
        seen, rounds = map(int, self.end.get()) if self.end.exists() else (-1, 0)
        before = {int(k[0]) for k in self.open.keys()}
        last: dict[int, tuple] = {}
        for row in rows:
            place = row["attempt_count"] or 0, row["acknowledged"]
            last[row["offset"]] = max(last.get(row["offset"], place), place)
        opened = {offset for offset, (_, acknowledged) in last.items() if not acknowledged}
        for offset in opened - before:
            self.open.updateValue((offset,), (1,))
        for offset in before & (last.keys() - opened):
            self.open.removeKey((offset,))
        held, seen = (before - last.keys()) | opened, max(seen, *last)
        self.end.update((seen, rounds + 1))
        yield _COMMIT(*key, min(held) if held else seen + 1, len(held), seen, rounds + 1)

    def close(self) -> None:
        pass


def commits(found: DataFrame) -> DataFrame:
    """How far each partition may be committed, after each batch of results: all positions below the first open one."""
    own = found.where("offset IS NOT NULL").select(*POSITION, "attempt_count", "acknowledged")
    return own.groupBy("topic", "partition").transformWithState(CommitProcessor(), COMMITS, "Append", "None")


def run(stream: DataFrame, schema: str, to: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all it holds now, into files that take each batch once, and returns them. With the same checkpoint
    it goes on where it ended."""
    started = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(to)
    try:
        started.awaitTermination()
    finally:
        started.stop()
    return stream.sparkSession.read.schema(schema).parquet(to)


def failures(found: DataFrame) -> DataFrame:
    """Each position's failure row as its last attempt left it."""
    rows = found.where("attempt_count IS NOT NULL")
    names = ("attempt_count", *FAILURE, *(c for c in IDENTITY if c not in FAILURE), "quarantine_status", "acknowledged")
    return rows.groupBy(*POSITION).agg(F.max_by(F.struct(*names), "attempt_count").alias("l")).select(*POSITION, "l.*")


def committed(found: DataFrame) -> DataFrame:
    """Each partition's last commit."""
    return found.groupBy("topic", "partition").agg(F.max_by(F.struct("committed", "open"), "round").alias("l")).select("topic", "partition", "l.*")
