"""Commands with parents in the batch, against one after another."""

import random

import pytest
from pyspark.sql import functions as F

from eventfold.operators import commands as C

COMMANDS = "seq long, kind string, tenant_id string, entity_id string, parent_id string, item_id string, order_id string, quantity long, event_id string, causation_id string"


def one_after_another(commands, stored, stock, taken):
    left = {(t, i): [q, v] for t, i, q, v in stock}
    there = {(k, t, e): ev for k, t, e, _, _, ev in stored}
    used = {(k, t, what, x) for k, t, _, p, o, _ in stored for what, x in (("parent", p), ("order", o)) if x is not None}
    sent = {(t, o): ev for k, t, _, _, o, ev in stored if k == "shipment"}
    orders, out = set(taken), []
    for seq, kind, t, e, parent, item, order, quantity, event, cause in sorted(commands):
        more = (None, None, None)
        if kind == "order":
            now = left.get((t, item))
            if quantity < 1:
                said = C.QUANTITY
            elif now is None:
                said = C.NO_ITEM
            elif now[0] < quantity or cause != sent.get((t, order)):
                said = C.INVALID
            elif order in orders:
                said = C.DUPLICATE_ORDER
            else:
                said, more = C.ACCEPTED, (now[0], now[0] - quantity, now[1] + 1)
                left[t, item] = [now[0] - quantity, now[1] + 1]
                orders.add(order)
        else:
            above = None if kind == "supplier" else C.LEVELS[C.LEVELS.index(kind) - 1]
            keys = {(kind, t, what, x) for what, x in (("parent", parent), ("order", order)) if x is not None}
            if above is None and cause is not None:
                said = C.CONTEXT
            elif above and (above, t, parent) not in there:
                said = C.UNKNOWN
            elif kind == "ingredient_lot" and (t, item) not in left:
                said = C.NO_ITEM
            elif above and cause != there[above, t, parent]:
                said = C.INVALID
            elif (kind, t, e) in there or keys & used:
                said = C.DUPLICATE
            else:
                said = C.ACCEPTED
                there[kind, t, e] = event
                used |= keys
                if kind == "shipment":
                    sent[t, order] = event
        out.append((seq, said, *more))
    return out


@pytest.mark.parametrize(("seed", "n", "ids"), [(1, 1500, 40), (2, 600, 6), (3, 60, 2)])
def test_levels_and_streams_equal_one_after_another(spark, seed, n, ids):
    r = random.Random(seed)
    stock = [(f"t{t}", f"i{i}", r.randrange(60), r.randrange(3)) for t in range(2) for i in range(4)]
    stored = [("supplier", "t0", "supplier0", None, None, "e-supplier0"), ("production_batch", "t1", "production_batch1", "ingredient_lot9", None, "e-b1"), ("shipment", "t0", "shipment0", "production_batch0", "o0", "e-s0")]
    rows = []
    for seq in range(n):
        kind = r.choice([*C.LEVELS, "order"])
        above = {"ingredient_lot": "supplier", "production_batch": "ingredient_lot", "shipment": "production_batch"}.get(kind)
        parent = f"{above}{r.randrange(ids)}" if above else None
        own, order = f"{kind}{r.randrange(ids)}", f"o{r.randrange(ids)}" if kind in ("shipment", "order") else None
        cause = None if r.random() < 0.1 or kind == "supplier" else f"e-{parent}" if above else None
        if kind == "order" and r.random() < 0.5:
            cause = f"e-shipment{r.randrange(ids)}"
        rows.append((seq, kind, f"t{r.randrange(2)}", None if kind == "order" else own, parent, f"i{r.randrange(5)}", order, r.randrange(9) if kind == "order" else None, f"e-{own}" if kind != "order" else f"e-order{seq}", cause))
    taken = ["o1"]
    frame = spark.createDataFrame(rows, COMMANDS).repartition(3)
    old = spark.createDataFrame(stored, "kind string, tenant_id string, entity_id string, parent_id string, order_id string, event_id string")
    there = spark.createDataFrame(stock, "tenant_id string, item_id string, quantity_on_hand long, aggregate_version long")
    found = C.accept(frame, old, there, spark.createDataFrame([(x,) for x in taken], "order_id string"))
    want = one_after_another(rows, stored, stock, taken)
    assert sorted(map(tuple, found.select("seq", "outcome", "quantity_before", "quantity_after", "aggregate_version").collect())) == want
    assert n < 100 or len({w[1] for w in want}) >= 7
    nothing = C.accept(frame.where(F.lit(False)), old, there)
    assert nothing.count() == 0


def test_an_order_id_passes_to_the_next_command_if_the_first_is_rejected(spark):
    rows = [(1, "order", "t", None, None, "a", "o", 9, "e1", None), (2, "order", "t", None, None, "b", "o", 2, "e2", None), (3, "order", "t", None, None, "b", "p", 2, "e3", None), (4, "order", "t", None, None, "a", "p", 1, "e4", None), (5, "order", "t", None, None, "a", "o", 1, "e5", None)]
    stock = spark.createDataFrame([("t", "a", 3, 0), ("t", "b", 3, 0)], "tenant_id string, item_id string, quantity_on_hand long, aggregate_version long")
    nothing = spark.createDataFrame([], "kind string, tenant_id string, entity_id string, parent_id string, order_id string, event_id string")
    found = {x["seq"]: x["outcome"] for x in C.accept(spark.createDataFrame(rows, COMMANDS), nothing, stock).collect()}
    assert found == {1: C.INVALID, 2: C.ACCEPTED, 3: C.INVALID, 4: C.ACCEPTED, 5: C.DUPLICATE_ORDER}


def test_only_orders_that_stock_decides_are_taken_in_sequence(spark, monkeypatch):
    """Wrong quantities, unknown items, wrong causes and more than the whole stock need no stream."""
    streamed = []
    through = C.map_stream
    monkeypatch.setattr(C, "map_stream", lambda df, *more: streamed.append(sorted(r["seq"] for r in df.collect())) or through(df, *more))
    order = lambda seq, item, quantity, cause=None: (seq, "order", "t", None, None, item, f"o{seq}", quantity, f"e{seq}", cause)
    rows = [order(1, "a", 0), order(2, "a", None), order(3, "none", 1), order(4, "a", 1, "x"), order(5, "a", 4), order(6, "a", 2), order(7, "a", 2), order(8, "a", 1), order(9, "full", 1), order(10, "a", 2**53)]
    stock = spark.createDataFrame([("t", "a", 3, 0), ("t", "full", 3, C.LARGEST)], "tenant_id string, item_id string, quantity_on_hand long, aggregate_version long")
    nothing = spark.createDataFrame([], "kind string, tenant_id string, entity_id string, parent_id string, order_id string, event_id string")
    found = {x["seq"]: (x["outcome"], x["quantity_before"], x["quantity_after"], x["aggregate_version"]) for x in C.accept(spark.createDataFrame(rows, COMMANDS), nothing, stock).collect()}
    no = lambda outcome: (outcome, None, None, None)
    want = {1: no(C.QUANTITY), 2: no(C.QUANTITY), 3: no(C.NO_ITEM), 4: no(C.INVALID), 5: no(C.INVALID), 6: (C.ACCEPTED, 3, 1, 1), 7: no(C.INVALID), 8: (C.ACCEPTED, 1, 0, 2), 9: no(C.INVALID), 10: no(C.QUANTITY)}
    assert found == want and streamed == [[6, 7, 8]]
