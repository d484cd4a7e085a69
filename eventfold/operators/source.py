"""The forecast source at a cutoff from the retained outbox and the inbox, replay onto existing state, and release.

Outbox rows: event_id, tenant_id, item_id, version, content_hash, status, recorded_at, before, dec, after.
Inbox rows: event_id, tenant_id, item_id, version, content_hash, disposition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.ordered import numbered
from eventfold.functions.stream import map_stream
from eventfold.functions.text import line, ordered_hash
from eventfold.operators import fold as R
from eventfold.operators.replay import inventory_checksum
from eventfold.sources.tables import written

ACCEPTED = ("applied", "duplicate_noop")
#: Inbox states after which an event is never released.
TERMINAL = (*R.TERMINAL, "quarantined_gap")


def history_offsets(outbox: DataFrame) -> DataFrame:
    """Retained rows with the synthetic offsets 1, 2, ... of partition 1 of their tenant: by aggregate, version, time and id."""
    return numbered(outbox.withColumn("partition", F.lit(1)), ["tenant_id"], ["item_id", "version", "recorded_at", "event_id"], "offset")


def until(outbox: DataFrame, cutoff: Column) -> DataFrame:
    """What was available at the cutoff, by the time of recording and not of occurrence."""
    return outbox.where(F.col("recorded_at") <= cutoff)


def classified(outbox: DataFrame, inbox: DataFrame) -> DataFrame:
    """Outbox rows with the reason why each cannot be used, null for accepted ones. The first rule that fails is told.

    Of retained values that were parsed again (columns ``parsed_`` of event_id, tenant_id, item_id, version, content_hash,
    recorded_at and malformed) the identity, hash and time have to be those of the row; without them, only the
    arithmetic is checked. Of accepted rows with one event_id the first in scan order counts."""
    own = ("event_id", "tenant_id")
    seen = inbox.select(*own, *(F.col(c).alias(f"_{c}") for c in ("item_id", "version", "content_hash", "disposition")))
    rows = outbox.join(seen, list(own), "left")
    say = lambda text: F.concat(F.lit(text + " "), "event_id")
    differs = lambda a, names: ~F.lit(True) if not names else F.exists(F.array(*(~F.col(f"{a}{c}").eqNullSafe(F.col(c)) for c in names)), lambda x: x)
    retained = "parsed_event_id" in outbox.columns
    hash_ = F.lower("parsed_content_hash") != F.lower("content_hash") if retained else F.lit(False)
    reason = (
        F.when(F.col("parsed_malformed") if retained else F.col("before") - F.col("dec") != F.col("after"), say("incomplete:malformed retained event"))
        .when(differs("parsed_", ("event_id", "tenant_id", "item_id", "version") if retained else ()), say("incomplete:event identity or tenant mismatch"))
        .when(F.coalesce(hash_, F.lit(True)), say("incomplete:outbox content hash mismatch"))
        .when(differs("parsed_", ("recorded_at",) if retained else ()), say("incomplete:recorded_at mismatch"))
        .when(F.col("_disposition").isNull() & F.col("status").isin("pending", "publishing", "published"), say("stale:inventory event not applied"))
        .when(F.col("_disposition").isNull(), say("incomplete:inventory event has no platform disposition"))
        .when(differs("_", ("item_id", "version")), say("incomplete:inbox event identity mismatch"))
        .when(F.lower("_content_hash") != F.lower("content_hash"), say("incomplete:inbox content hash mismatch"))
        .when(~F.col("_disposition").isin(*ACCEPTED), F.concat(F.lit("incomplete:inventory event disposition "), "_disposition", F.lit(" "), "event_id"))
    )
    rows = rows.withColumn("reason", reason)
    once = Window.partitionBy("tenant_id", "event_id", F.col("reason").isNull()).orderBy("item_id", "version", "recorded_at")
    again = F.col("reason").isNull() & (F.row_number().over(once) > 1)
    return rows.select(*outbox.columns, F.when(again, say("incomplete:duplicate retained event")).otherwise(F.col("reason")).alias("reason"))


def inbox_reasons(outbox: DataFrame, inbox: DataFrame, accepted: DataFrame, cutoff: Column) -> DataFrame:
    """(tenant_id, reason) of inbox rows without an accepted retained event, and of gap and stale rows, up to the cutoff."""
    retained = outbox.select("event_id", "tenant_id", F.col("recorded_at").alias("_at"), F.lit(True).alias("_kept"))
    rows = inbox.join(retained, ["event_id", "tenant_id"], "left").where(F.col("_kept").isNull() | (F.col("_at") <= cutoff))
    rows = rows.join(accepted.select("event_id", "tenant_id", F.lit(True).alias("_ok")), ["event_id", "tenant_id"], "left")
    missing = F.when(F.col("_ok").isNull(), F.concat(F.lit("incomplete:inventory inbox event missing retained outbox "), "event_id"))
    held = F.when(F.col("disposition").isin("quarantined_gap", "quarantined_stale"), F.concat(F.lit("incomplete:inventory inbox disposition "), "disposition", F.lit(" "), "event_id"))
    return rows.select("tenant_id", F.explode(F.array_compact(F.array(missing, held))).alias("reason"))


REPLAYED = "tenant_id string, item_id string, event_id string, version long, recorded_at timestamp, quantity long, reason string"


def replayed(accepted: DataFrame) -> DataFrame:
    """Accepted events with the quantity after each, or the reason why it does not follow. What is expected does not move
    past an event that does not follow, so all later versions are gaps too."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (tenant, item), own in groupby(rows, lambda r: r[:2]):
            expected, current = 1, None
            for _, _, version, event, at, before, dec, after in own:
                reason = None
                if version != expected:
                    reason = f"incomplete:aggregate version gap {item} expected {expected} received {version}"
                elif version > 1 and before != current:
                    reason = f"incomplete:quantity transition mismatch {event}"
                elif before - dec != after or after < 0:
                    reason = f"incomplete:quantity arithmetic mismatch {event}"
                else:
                    expected, current = expected + 1, after
                yield tenant, item, event, version, at, None if reason else after, reason

    names = ("tenant_id", "item_id", "version", "event_id", "recorded_at", "before", "dec", "after")
    return map_stream(accepted.select(*names).repartition("tenant_id", "item_id").sortWithinPartitions(*names[:4]), REPLAYED, run)


def observations(replay: DataFrame) -> DataFrame:
    """The last valid quantity of each day on which something was recorded; other days are not filled."""
    day = F.to_date("recorded_at").alias("as_of_date")
    return replay.where("reason IS NULL").groupBy("tenant_id", "item_id", day).agg(F.max_by("quantity", "version").alias("quantity_on_hand"))


def projection_reasons(last: DataFrame, projection: DataFrame) -> DataFrame:
    """(tenant_id, reason) of items in which a stored projection and the replay's last state differ; both columns may."""
    key = ["tenant_id", "item_id"]
    a = projection.select(*key, F.col("quantity_on_hand").alias("_q"), F.col("aggregate_version").alias("_v"))
    b = last.select(*key, F.col("quantity_on_hand").alias("_rq"), F.col("aggregate_version").alias("_rv"))
    both = a.join(b, key, "full_outer")
    say = lambda test, text: F.when(test, F.concat(F.lit(f"incomplete:{text} "), "item_id"))
    there, replayed_ = F.col("_v").isNotNull(), F.col("_rv").isNotNull()
    found = F.array(
        say(there & ~replayed_, "projection item missing retained history"), say(there & replayed_ & (F.col("_q") != F.col("_rq")), "projection quantity differs from replay"),
        say(there & replayed_ & (F.col("_v") != F.col("_rv")), "projection version differs from replay"), say(~there & replayed_, "replayed item missing projection"),
    )
    return both.select("tenant_id", F.explode(F.array_compact(found)).alias("reason"))


def last_states(replay: DataFrame) -> DataFrame:
    """The last valid state of each item that has one."""
    ok = replay.where("reason IS NULL").groupBy("tenant_id", "item_id")
    return ok.agg(F.max_by("quantity", "version").alias("quantity_on_hand"), F.max("version").alias("aggregate_version"))


def source_reasons(outbox: DataFrame, inbox: DataFrame, cutoff: Column, projection: DataFrame | None = None) -> DataFrame:
    """All distinct (tenant_id, reason) of the source at a cutoff; with the stored projection, also where it differs."""
    rows = written(classified(until(outbox, cutoff), inbox), "classified")
    return _reasons(rows, outbox, inbox, written(replayed(rows.where("reason IS NULL")), "replayed"), cutoff, projection)


def _reasons(rows, outbox, inbox, replay, cutoff, projection) -> DataFrame:
    parts = rows.select("tenant_id", "reason").unionByName(inbox_reasons(outbox, inbox, rows.where("reason IS NULL"), cutoff)).unionByName(replay.select("tenant_id", "reason"))
    if projection is not None:
        parts = parts.unionByName(projection_reasons(last_states(replay), projection))
    return parts.where("trim(reason) <> ''").distinct()


def boundary(accepted: DataFrame) -> DataFrame:
    """The greatest time of recording of each tenant's accepted events, and the first event in scan order that has it."""
    most = F.max(F.struct("recorded_at"))["recorded_at"]
    first = F.min_by("event_id", F.struct("item_id", "version", "event_id"))
    last = accepted.groupBy("tenant_id").agg(most.alias("recorded_at"))
    return accepted.join(last, ["tenant_id", "recorded_at"]).groupBy("tenant_id", "recorded_at").agg(first.alias("event_id"))


def history_checksum(accepted: DataFrame) -> DataFrame:
    """One hash of each tenant's accepted events, in the order of item, version and id."""
    at = F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "recorded_text" not in accepted.columns else F.col("recorded_text")
    return ordered_hash(accepted, ["tenant_id"], line("tenant_id", "item_id", "version", "event_id", F.lower("content_hash"), at), "item_id", "version", "event_id", name="history_checksum")


def forecast_source(outbox: DataFrame, inbox: DataFrame, projection: DataFrame, cutoff: Column) -> DataFrame:
    """The source of each tenant at a cutoff, a row for each: status, sorted reasons, numbers of accepted and observed, the
    boundary's time and date, and the checksums of history and projection.

    complete without a reason; stale if all begin with ``stale:``; else incomplete. A tenant is one that has retained
    rows, inbox rows or a projection. Each input is read once into a written table, and so is what was made of it."""
    rows = written(classified(until(outbox, cutoff), inbox), "classified")
    accepted = rows.where("reason IS NULL")
    replay = written(replayed(accepted), "replayed")
    told = _reasons(rows, outbox, inbox, replay, cutoff, projection)
    told = told.groupBy("tenant_id").agg(F.array_sort(F.collect_set("reason")).alias("status_reasons"))
    tenants = outbox.select("tenant_id").union(inbox.select("tenant_id")).union(projection.select("tenant_id")).distinct()
    counts = accepted.groupBy("tenant_id").agg(F.count("*").alias("applied_event_count"), F.max("recorded_at").alias("max_recorded_at"))
    seen = observations(replay).groupBy("tenant_id").agg(F.count("*").alias("n_observations"))
    sums = inventory_checksum(projection, ("tenant_id",)).withColumnRenamed("checksum", "projection_checksum")
    out = tenants.join(told, "tenant_id", "left").join(counts, "tenant_id", "left").join(seen, "tenant_id", "left").join(history_checksum(accepted), "tenant_id", "left").join(sums, "tenant_id", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    reasons = F.coalesce("status_reasons", F.array().cast("array<string>"))
    status = F.when(F.size(reasons) == 0, "complete").when(F.forall(reasons, lambda r: r.startswith("stale:")), "stale").otherwise("incomplete")
    return out.select(
        "tenant_id", status.alias("status"), reasons.alias("status_reasons"), F.coalesce("applied_event_count", F.lit(0)).alias("applied_event_count"), F.coalesce("n_observations", F.lit(0)).alias("n_observations"),
        "max_recorded_at", F.to_date("max_recorded_at").alias("source_cutoff_date"), F.coalesce("history_checksum", none).alias("history_checksum"), F.coalesce("projection_checksum", none).alias("projection_checksum"),
    )


STATE = R.RECORD + ", disposition string"
RESULTS = "group string, seq long, event_id string, disposition string"


def replay_onto(state: DataFrame, history: DataFrame) -> DataFrame:
    """What becomes of each retained record that is delivered again onto existing state, without a reset.

    ``state`` (columns of ``STATE``): inbox rows with their record, and of each aggregate a row with disposition
    ``projection``, its quantity in ``after`` and its version.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, own in groupby(rows, lambda r: r[0]):
            group = R.Group()
            for row in own:
                r = R.Record._make(row[:-2])
                if not row[-1]:
                    group.load(r, row[-2])
                else:
                    yield r.group, r.seq, r.event_id, list(group.deliver(r))[0][3]

    names = [c.split()[0] for c in STATE.split(", ")]
    both = state.select(*names, F.lit(False).alias("_fresh")).unionByName(R.columns(history).select("*", F.lit(None).cast("string").alias("disposition"), F.lit(True).alias("_fresh")))
    return map_stream(both.repartition("group").sortWithinPartitions("group", "_fresh", "seq"), RESULTS, run)


def replay_counts(results: DataFrame, *by: str) -> DataFrame:
    """Deliveries by what became of them; complete without a quarantine or gap among at least one."""
    state = F.col("disposition")
    counts = results.groupBy(*by).agg(
        F.count_if(state == "applied").alias("applied"), F.count_if(state == "duplicate_noop").alias("duplicate_noop"), F.count_if(state.startswith("quarantined") & (state != "quarantined_gap")).alias("quarantined"),
        F.count_if(state == "quarantined_gap").alias("gaps"), F.count("*").alias("n"),
    )
    return counts.withColumn("status", F.when((F.col("n") > 0) & (F.col("quarantined") + F.col("gaps") == 0), "complete").otherwise("incomplete"))


def release_outcomes(requests: DataFrame, inbox: DataFrame, outbox: DataFrame, failures: DataFrame) -> DataFrame:
    """Requests (tenant_id, event_id) with what a release does: not_releasable after a terminal inbox state; pending for
    a quarantined outbox row; redrive for a quarantined failure with exactly one retained record; else not_found."""
    key = ["tenant_id", "event_id"]
    asked = requests.join(inbox.select(*key, "disposition"), key, "left")
    kept = outbox.groupBy(*key).agg(F.count("*").alias("_retained"), F.bool_or(F.col("status") == "quarantined").alias("_held"))
    failed = failures.where("quarantine_status = 'quarantined'").select(*key).distinct().withColumn("_failed", F.lit(True))
    rows = asked.join(kept, key, "left").join(failed, key, "left")
    outcome = (
        F.when(F.col("disposition").isin(*TERMINAL), "not_releasable").when(F.col("_held"), "pending").when(F.col("_failed").isNull(), "not_found")
        .when(F.coalesce("_retained", F.lit(0)) == 1, "redrive").otherwise("not_releasable")
    )
    return rows.select(*requests.columns, outcome.alias("outcome"))
