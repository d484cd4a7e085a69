"""Evaluation of scores against labels, the bucket-rate model, selection and promotion.

Inputs are rows (row_id, split, label, score) with null scores for abstentions; further columns in ``by``
evaluate several models in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
LEAST_SUPPORT = 5
COVERAGE = 80


def score_problem() -> Column:
    """A reason why a score cannot be used, null if it can."""
    s = F.col("score")
    return F.when(F.isnan(s), "not a number").when(s.between(0, 1) | s.isNull(), None).otherwise("out of range")


SLICES = 4096


def ranked_by_score(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Scored rows with rank and hits, the labels up to it, by falling score and then row_id.

    No task holds all rows of a group: rows are ranked among equal scores with the same beginning of the row_id; the
    numbers of those sets, added up within a slice of the scores and over the slices, say where each begins.
    """
    rows = rows.where("score IS NOT NULL").withColumns({"_slice": F.floor(F.col("score") * SLICES), "_head": F.substring("row_id", 1, 2)})
    sets = rows.groupBy(*by, "_slice", "score", "_head").agg(F.count("*").alias("n"), F.sum("label").alias("h"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy(*by, "_slice").orderBy(F.desc("score"), "_head"))
    sets = sets.withColumns({"_n": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_h": F.coalesce(F.sum("h").over(inside), F.lit(0))})
    slices = sets.groupBy(*by, "_slice").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    above = before(Window.partitionBy(*by).orderBy(F.desc("_slice")))
    slices = slices.select(*by, "_slice", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_sn"), F.coalesce(F.sum("h").over(above), F.lit(0)).alias("_sh"))
    firsts = sets.join(slices, [*by, "_slice"]).select(*by, "_slice", "score", "_head", (F.col("_n") + F.col("_sn")).alias("_n"), (F.col("_h") + F.col("_sh")).alias("_h"))
    own = Window.partitionBy(*by, "_slice", "score", "_head").orderBy("row_id")
    ranked = rows.withColumns({"rank": F.row_number().over(own), "hits": F.sum("label").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    ranked = ranked.join(firsts, [*by, "_slice", "score", "_head"])
    return ranked.withColumns({"rank": F.col("rank") + F.col("_n"), "hits": F.col("hits") + F.col("_h")}).drop("_slice", "_head", "_n", "_h")


def evaluate(rows: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """n, predicted, abstained, positives, ap, brier, coverage and the reason why a metric is undefined.

    Average precision is not interpolated; ties of score go by row_id.
    """
    scored = F.col("score").isNotNull()
    ranked = ranked_by_score(rows, by).select(*by, "row_id", "label", "score", F.when(F.col("label") == 1, F.col("hits") / F.col("rank")).alias("gain"))
    ranked = ranked.unionByName(rows.where("score IS NULL").select(*by, "row_id", "label", "score", F.lit(None).cast("double").alias("gain")))
    out = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(scored).alias("predicted"), F.count_if(~scored).alias("abstained"), F.sum("label").cast("long").alias("positives"),
        (F.sum("gain") / F.count_if(scored & (F.col("label") == 1))).alias("_ap"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("_brier"),
        F.count_if(scored & (F.col("label") == 1)).alias("_hits"),
    )
    one_class = (F.col("positives") == 0) | (F.col("positives") == F.col("n"))
    reason = F.when(one_class, "degenerate class").when(F.col("predicted") == 0, "all abstained").when(F.col("_hits") == 0, "undefined average precision")
    out = out.withColumn("reason", reason)
    return out.select(
        *by, "n", "predicted", "abstained", "positives", F.when(F.col("reason").isNull(), F.col("_ap")).alias("ap"),
        F.when(F.coalesce("reason", F.lit("")).isin("", "undefined average precision"), F.col("_brier")).alias("brier"),
        (F.col("predicted") / F.col("n")).alias("coverage"), "reason",
    )


def qualifies() -> Column:
    return F.col("ap").isNotNull() & F.col("brier").isNotNull() & (F.col("predicted") * 100 >= F.col("n") * COVERAGE)


def best(results: DataFrame, model: str = "model") -> DataFrame:
    """The best qualifying model of each split: greater ap, smaller brier, greater coverage, smaller name."""
    order = Window.partitionBy("split").orderBy(F.desc("ap"), "brier", F.desc("coverage"), model)
    return results.where(qualifies()).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def promoted() -> Column:
    """Whether columns candidate_ap and candidate_brier beat ap and brier of the best baseline."""
    return F.coalesce((F.col("candidate_ap") > F.col("ap")) & (F.col("candidate_brier") <= F.col("brier")), F.lit(False))


def bucket(quantity: str = "quantity_on_hand") -> Column:
    q = F.col(quantity)
    return F.when(q < 0, None).when(q == 0, "zero").when(q <= 2, "low").when(q <= 7, "medium").when(q > 7, "high")


def fit_rates(rows: DataFrame) -> DataFrame:
    """bucket, n and positives of the training rows."""
    return rows.where("split = 'train'").withColumn("bucket", bucket()).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))


def wilson(positives: Column, n: Column) -> tuple[Column, Column]:
    """The interval, not wider than [0, 1]."""
    p, z2 = positives / n, Z * Z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def rates(counts: DataFrame) -> DataFrame:
    """Smoothed rate of each bucket, null below the least support, and an interval that contains it."""
    rate = F.when(F.col("n") >= LEAST_SUPPORT, (F.col("positives") + 1) / (F.col("n") + 2))
    low, high = wilson(F.col("positives"), F.col("n"))
    return counts.withColumns({"rate": rate, "lower": F.when(rate.isNotNull(), F.least(low, rate)), "upper": F.when(rate.isNotNull(), F.greatest(high, rate))})


def predict_rates(rows: DataFrame) -> DataFrame:
    """``rows`` with bucket, score and interval: rates of the training rows' buckets, which are at most four."""
    model = F.broadcast(rates(fit_rates(rows)).select("bucket", F.col("rate").alias("score"), "lower", "upper", F.col("n").alias("support")))
    reason = F.when(F.col("bucket").isNull(), "unsupported input").when(F.col("score").isNull(), "insufficient support")
    return rows.withColumn("bucket", bucket()).join(model, "bucket", "left").withColumn("abstention_reason", reason)


def bijection_problems(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, or that one side has twice."""
    sides = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = sides.groupBy(*key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    problem = F.when(F.col("l") == 0, "missing left").when(F.col("r") == 0, "missing right").when((F.col("l") > 1) | (F.col("r") > 1), "duplicate")
    return counts.select(*key, problem.alias("problem")).where("problem IS NOT NULL")
