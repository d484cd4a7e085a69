"""Daily series: validation, labels, splits, features, baselines.

All take a history (tenant_id, item_id, as_of_date, quantity_on_hand). Every window has the same
partitioning and order, so one shuffle and one sort serve all columns of a query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.stream import map_stream
from eventfold.functions.text import line, ordered_hash, sha256

SERIES = ("tenant_id", "item_id")
HORIZON = 7
SPLITS = (("train", 70), ("validation", 14), ("test", 21))
PROTOCOL = "m4-stockout-eval-v1"


def _days() -> Column:
    return F.unix_date("as_of_date")


def _range(low: int, high: int):
    """Rows of the series between two distances in days."""
    return Window.partitionBy(*SERIES).orderBy(_days()).rangeBetween(low, high)


def normalised(history: DataFrame) -> DataFrame:
    return history.withColumns({c: F.lower(F.trim(c)) for c in SERIES})


def violations(history: DataFrame) -> DataFrame:
    """tenant_id, item_id and a reason for each rule that a series breaks."""
    per = history.groupBy(*SERIES).agg(
        F.min("quantity_on_hand").alias("least"), F.count("*").alias("n"), F.count_distinct("as_of_date").alias("days"),
        F.datediff(F.max("as_of_date"), F.min("as_of_date")).alias("reach"), F.count_if(F.col("as_of_date").isNull()).alias("undated"),
    )
    rules = {
        "negative quantity": F.col("least") < 0, "bad date": F.col("undated") > 0, "duplicate date": F.col("n") - F.col("undated") > F.col("days"),
        "gap": F.col("reach") + 1 > F.col("days"), "empty item": F.coalesce("item_id", F.lit("")) == "",
    }
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return per.select(*SERIES, F.explode(reasons).alias("reason"))


def with_labels(history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows that have ``horizon`` later days; label 1 if any of those has nothing on hand."""
    ahead = _range(1, horizon)
    zero = (F.col("quantity_on_hand") == 0).cast("int")
    return history.withColumns({"label": F.max(zero).over(ahead), "_ahead": F.count("*").over(ahead)}).where(F.col("_ahead") == horizon).drop("_ahead")


def split_dates(labelled: DataFrame, splits=SPLITS) -> DataFrame:
    """as_of_date, date_no, split: by the number of the date among all dates of all series; later ones have no split.

    Numbered on the distinct dates, of which a calendar has few.
    """
    number = F.row_number().over(Window.orderBy("as_of_date")).cast("long")
    name, end = None, 0
    for split, days in splits:
        end += days
        test = F.col("date_no") <= end
        name = F.when(test, split) if name is None else name.when(test, split)
    return labelled.select("as_of_date").distinct().withColumn("date_no", number).withColumn("split", name)


def with_history_hash(history: DataFrame) -> DataFrame:
    """SHA-256 of the lines (date, quantity) of the series up to the row's date: one ordered pass, in which the hash of a
    series goes from row to row. Rows of a date take the order of their lines."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in history.schema)
    at = [history.columns.index(c) for c in SERIES]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = digest = None
        for *row, text in rows:
            if digest is None or [row[k] for k in at] != key:
                key, digest = [row[k] for k in at], hashlib.sha256()
            digest.update(text.encode())
            yield *row, digest.hexdigest()

    lines = history.withColumn("_line", line("as_of_date", "quantity_on_hand"))
    ordered = lines.repartition(*SERIES).sortWithinPartitions(*SERIES, "as_of_date", "_line")
    return map_stream(ordered, f"{schema}, history_hash string", run)


def row_id(protocol: str = PROTOCOL) -> Column:
    return sha256(line(F.lit(protocol), "tenant_id", "item_id", "as_of_date"))


def dataset(history: DataFrame, protocol: str = PROTOCOL, splits=SPLITS, horizon: int = HORIZON, hashed: bool = True) -> DataFrame:
    """Labelled rows with identity, split, cutoff and history hash, and their quantity. Where nothing needs the hash, it is
    null without ``hashed`` and costs no pass."""
    history = normalised(history)
    history = with_history_hash(history) if hashed else history.withColumn("history_hash", F.lit(None).cast("string"))
    rows = with_labels(history, horizon)
    rows = rows.join(F.broadcast(split_dates(rows, splits)), "as_of_date").where("split IS NOT NULL")
    return rows.select(row_id(protocol).alias("row_id"), *SERIES, "as_of_date", "label", "split", F.col("as_of_date").alias("source_cutoff_date"), "history_hash", "quantity_on_hand")


DATASET_LINE = ("row_id", "tenant_id", "item_id", "as_of_date", "label", "split", "source_cutoff_date", "history_hash")
FEATURE_LINE = ("row_id", "tenant_id", "item_id", "as_of_date", "source_cutoff_date", "split", "quantity_on_hand", "history_hash")
ORDER = ("tenant_id", "item_id", "as_of_date")


def dataset_checksum(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return ordered_hash(rows, list(by), line(*DATASET_LINE), *ORDER)


def feature_snapshot(rows: DataFrame, header: dict, reasons: tuple[str, ...] = ()) -> DataFrame:
    """checksum and snapshot_id of feature rows under a header: contract, status, tenant, dataset version, feature
    definition, history and projection checksums, greatest recorded_at, cutoff and number of applied events."""
    names = ("contract", "status", "tenant", "dataset", "features", "history", "projection", "max_recorded_at", "cutoff", "applied")
    head = [F.lit(str(header[n])) for n in names]
    tail = "".join(f"reason\t{r}\n" for r in sorted({r.strip() for r in reasons} - {""}))
    summed = ordered_hash(rows, [], line(*FEATURE_LINE), *ORDER, head="\t".join(str(header[n]) for n in names) + "\n", tail=tail)
    return summed.withColumn("snapshot_id", sha256(line(head[0], *head[2:], "checksum")))


def moving_average(days: int = HORIZON) -> Column:
    """Share of days with nothing on hand among the last ``days``; null if one is missing."""
    back = _range(1 - days, 0)
    zeros = F.sum((F.col("quantity_on_hand") == 0).cast("int")).over(back)
    return F.when(F.count("*").over(back) == days, zeros / F.lit(float(days)))


def seasonal_naive(horizon: int = HORIZON) -> Column:
    """The label of the example a horizon earlier; null if there is none. For evaluation, over labelled rows."""
    return F.max("label").over(_range(-horizon, -horizon)).cast("double")


def runtime_seasonal_naive(horizon: int = HORIZON) -> Column:
    """1 if a day of the last ``horizon`` has nothing on hand and none before it in them is missing, 0 if all are
    there and none has; else null."""
    frame = _range(1 - horizon, 0)
    first_zero = F.min(F.when(F.col("quantity_on_hand") == 0, _days())).over(frame)
    days = F.collect_list(F.when(F.col("quantity_on_hand").isNotNull(), _days())).over(frame)
    upto = F.size(F.filter(days, lambda d: d <= first_zero))
    start = _days() - (horizon - 1)
    return F.when(first_zero.isNotNull() & (upto == first_zero - start + 1), 1.0).when(first_zero.isNull() & (F.size(days) == horizon), 0.0)
