"""Numbers in a total order, without a window over the rows that are numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.sources.tables import written


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` = 1, 2, ... in ``order`` within ``by``, of which each may hold all rows.

    Rows are dealt to range partitions in the order of (by, order) and sorted there, and written with the number of their
    partition and their place in it. Of these the first place and the count are taken for each (by, partition): as many
    small rows as partitions, and one more for each key. Their running sums are what has to be added to the places."""
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "ordered")
    counts = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_add", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from") + 1).drop("_from", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    first = first.select("_add", F.col("_part").alias("_of"), *(F.col(c).alias(f"_{c}") for c in by))
    joined = placed.join(first, [F.col("_part") == F.col("_of"), *same])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_add")).alias(name))
