"""Rows of streams as plain values, and the replay's stored state, which is read and not windowed again."""

import datetime
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventfold.functions.stream import map_stream, values_of
from eventfold.plans.processing import replay_inputs

COLUMNS = [
    pa.array(["a", None, "é\0", ""]), pa.array([b"a", None, b"\xff", b""]), pa.array([2**62 + 1, None, -(2**63), 0], "int64"), pa.array([1, 2, 3, 4], "int32"), pa.array([True, None, False, True]), pa.array([True, False, False, True]),
    pa.array([0.5, None, -0.0, 1e300]), pa.array([1.0, 2.0, 3.0, 4.0]), pa.array([None] * 4, "int64"), pa.array([None] * 4, "string"), pa.array([datetime.date(2024, 1, 1), None, None, None]), pa.array([[1], None, [], [2, None]]), pa.array([], "int64"), pa.array([], "string"),
]


@pytest.mark.parametrize("column", COLUMNS, ids=lambda c: f"{c.type}-{c.null_count}-{len(c)}")
def test_values_are_those_of_to_pylist(column):
    for c in (column, column[1:3]):
        found, want = values_of(c), c.to_pylist()
        assert found == want and [type(x) for x in found] == [type(x) for x in want]


def test_nan_is_no_null():
    found = values_of(pa.array([math.nan, None]))
    assert math.isnan(found[0]) and found[1] is None


def test_a_stream_makes_no_scalar_objects(spark):
    """Rows come from whole columns: Arrow's ``to_pydict`` and ``to_pylist`` are not called for text and numbers."""

    def same(rows):
        yield from rows

    rows = spark.range(10).select(F.when(F.col("id") != 3, F.col("id")).alias("n"), F.col("id").cast("string").alias("t"))
    assert sorted(map(tuple, map_stream(rows, "n long, t string", same).where("n IS NOT NULL").collect())) == [(k, str(k)) for k in range(10) if k != 3]
    assert "to_pydict" not in map_stream.__code__.co_names + tuple(n for c in _codes(map_stream.__code__) for n in c.co_names)


def _codes(code):
    for c in code.co_consts:
        if hasattr(c, "co_names"):
            yield c
            yield from _codes(c)


def test_stored_state_is_read_without_a_window(spark):
    state, history = replay_inputs(spark, "/root/testdata/sf0.001")
    for rows in (state, history):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
    assert state.where("disposition = 'projection'").groupBy("group").count().where("count > 1").count() == 0
