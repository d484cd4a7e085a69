"""Source commands accepted one after another, parents within the batch included.

Five kinds: supplier, ingredient_lot, production_batch and shipment, each under the one before, and order. Commands are
taken in the order of ``seq``, those that are accepted change what later ones meet. That order is not a task's loop over
all of them. Kinds depend on one another in one direction only, so they are done level by level: a level is a join with
the level above, of which only what was accepted earlier counts, and then the greedy choice under unique keys
(``lineage.won``: a parent, an id and an order are taken once). Orders that can't be accepted whatever came before are told
apart by columns; the others of an item take stock in a stream over (item, seq) that holds one number; as an order_id is taken once over all items, its streams are repeated until what was accepted
does not change, which the earliest difference bounds.

Commands: seq (no two alike), kind, tenant_id, entity_id, parent_id, item_id, order_id, quantity, event_id, causation_id.
Stored sources: kind, tenant_id, entity_id, parent_id, order_id, event_id. Stock: tenant_id, item_id, quantity_on_hand,
aggregate_version. An order is its own entity: its id is in order_id. Event ids are taken to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stream import map_stream
from eventfold.operators.lineage import won
from eventfold.sources.tables import written

LEVELS = ("supplier", "ingredient_lot", "production_batch", "shipment")
ACCEPTED, UNKNOWN, NO_ITEM, INVALID, DUPLICATE, DUPLICATE_ORDER, CONTEXT, QUANTITY = (
    "accepted", "unknown lineage source", "unknown inventory item", "invalid transition", "duplicate source", "duplicate order", "tenant or context mismatch", "invalid quantity",
)
LARGEST = 2**53 - 1


def _named(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of sources as the greedy choice takes them: a row is known by its place."""
    return rows.select("tenant_id", F.lit(kind).alias("aggregate_type"), F.col("entity_id").alias("aggregate_id"), "parent_id", "order_id", "seq")


def accept_sources(commands: DataFrame, stored: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, shipments): seq and outcome of all commands but orders, and all shipments there are after them, with the seq of
    their acceptance (-1 for stored ones)."""
    stored = stored.withColumn("seq", F.lit(-1).cast("long"))
    items = stock.select("tenant_id", "item_id", F.lit(True).alias("_item"))
    outcomes, above = [], None
    for kind in LEVELS:
        rows = commands.where(F.col("kind") == kind)
        held = stored.where(F.col("kind") == kind)
        if above is None:
            problem = F.when(F.col("causation_id").isNotNull(), CONTEXT)
        else:
            parents = above.select("tenant_id", F.col("entity_id").alias("parent_id"), F.col("event_id").alias("_cause"), F.col("seq").alias("_since"))
            rows = rows.join(parents, ["tenant_id", "parent_id"], "left").join(items, ["tenant_id", "item_id"], "left")
            there = F.coalesce(F.col("_since") < F.col("seq"), F.lit(False))
            no_item = F.col("_item").isNull() if kind == "ingredient_lot" else F.lit(False)
            problem = F.when(~there, UNKNOWN).when(no_item, NO_ITEM).when(~F.col("causation_id").eqNullSafe(F.col("_cause")), INVALID)
        rows = written(rows.withColumn("_problem", problem).select(*commands.columns, "_problem"), kind)
        sound = rows.where("_problem IS NULL")
        first = won(_named(sound, kind), _named(held, kind)).select("seq", F.lit(True).alias("_won"))
        rows = written(rows.join(first, "seq", "left").withColumn("outcome", F.coalesce("_problem", F.when(F.col("_won"), ACCEPTED), F.lit(DUPLICATE))), f"{kind}-done")
        outcomes.append(rows.select("seq", "outcome"))
        names = ["tenant_id", "entity_id", "parent_id", "order_id", "event_id", "seq"]
        above = held.select(*names).unionByName(rows.where(F.col("outcome") == ACCEPTED).select(*names))
    every = outcomes[0]
    for more in outcomes[1:]:
        every = every.unionByName(more)
    return every, above


def accept_orders(orders: DataFrame, shipments: DataFrame, stock: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """seq, outcome, quantity_before, quantity_after and aggregate_version of order commands.

    An order whose id a shipment accepted earlier names has that shipment's event as its cause, any other one none.
    ``taken``: order_ids that are stored."""
    sent = shipments.select("tenant_id", "order_id", F.col("event_id").alias("_cause"), F.col("seq").alias("_since"))
    rows = orders.join(sent, ["tenant_id", "order_id"], "left").join(stock, ["tenant_id", "item_id"], "left")
    cause = F.when(F.col("_since") < F.col("seq"), F.col("_cause"))
    rows = rows.withColumn("_sound", F.col("causation_id").eqNullSafe(cause))
    if taken is not None:
        rows = rows.join(taken.select("order_id").distinct().withColumn("_taken", F.lit(True)), "order_id", "left")
    else:
        rows = rows.withColumn("_taken", F.lit(None).cast("boolean"))
    names = ("tenant_id", "item_id", "seq", "order_id", "quantity", "quantity_on_hand", "aggregate_version", "_taken")
    wrong = F.col("quantity").isNull() | ~F.col("quantity").between(1, LARGEST)
    never = (F.col("quantity") > F.col("quantity_on_hand")) | (F.col("aggregate_version") >= LARGEST) | ~F.col("_sound")  # stock only falls
    settled = F.when(wrong, QUANTITY).when(F.col("quantity_on_hand").isNull(), NO_ITEM).when(never, INVALID)
    rows = written(rows.select(*names, settled.alias("outcome")), "orders")
    ended, rows = rows.where("outcome IS NOT NULL").select("seq", "outcome"), rows.where("outcome IS NULL").select(*names)
    first, found, changed = None, None, 1
    while changed:
        said = rows.withColumn("_first", F.lit(None).cast("long")) if first is None else rows.join(first, "order_id", "left")
        dealt = said.select(*names, "_first").repartition("tenant_id", "item_id").sortWithinPartitions("tenant_id", "item_id", "seq")
        found = written(map_stream(dealt, "seq long, order_id string, outcome string, quantity_before long, quantity_after long, aggregate_version long", _take), "orders-taken")
        if first is None and not rows.groupBy("order_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            break
        now = found.where(F.col("outcome") == ACCEPTED).groupBy("order_id").agg(F.min("seq").alias("_first"))
        changed = first is None or now.join(first.withColumnRenamed("_first", "_was"), "order_id", "full_outer").where("NOT (_first <=> _was)").limit(1).count()
        first = now
    return ended.unionByName(found.drop("order_id"), allowMissingColumns=True).select("seq", "outcome", "quantity_before", "quantity_after", "aggregate_version")


def _take(rows: Iterator[tuple]) -> Iterator[tuple]:
    """An item's orders in sequence against its stock; one that is rejected takes nothing."""
    for _, own in groupby(rows, lambda r: r[:2]):
        left = version = None
        for _, _, seq, order, quantity, on_hand, start, taken, first in own:
            if left is None:
                left, version = on_hand, start
            if left < quantity or version >= LARGEST:
                outcome = INVALID
            elif taken or first is not None and first < seq:
                outcome = DUPLICATE_ORDER
            else:
                before, left, version = left, left - quantity, version + 1
                yield seq, order, ACCEPTED, before, left, version
                continue
            yield seq, order, outcome, None, None, None


def accept(commands: DataFrame, stored: DataFrame, stock: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """seq, outcome, quantity_before, quantity_after and aggregate_version of all commands."""
    sources, shipments = accept_sources(commands, stored, stock)
    orders = accept_orders(commands.where("kind = 'order'"), shipments, stock, taken)
    return sources.unionByName(orders, allowMissingColumns=True)
