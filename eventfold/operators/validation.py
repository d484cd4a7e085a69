"""Rules over evaluation inputs, artifacts, prediction records and commands, as tables of violations.

Each function returns a key and the first rule that a row breaks; a table without rows is a valid input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.operators.evaluation import bijection_problems
from eventfold.operators.series import row_id

SPLITS = ("train", "validation", "test")
STATUSES = ("predicted", "abstained")
REASONS = ("insufficient_support", "unsupported_input")
HORIZON = 7


def first_problem(rules: dict[str, Column]) -> Column:
    """The name of the first rule whose test holds; a test that is null does not."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules.items()))


def problems(rows: DataFrame, key: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    return rows.select(*key, first_problem(rules).alias("problem")).where("problem IS NOT NULL")


def split_problems(rows: DataFrame) -> DataFrame:
    """Dates (as_of_date) with several splits, and dates whose split comes before that of an earlier date."""
    number = F.when(F.col("split") == SPLITS[0], 0).when(F.col("split") == SPLITS[1], 1).when(F.col("split") == SPLITS[2], 2)
    dates = rows.groupBy("as_of_date").agg(F.count_distinct("split").alias("n"), F.max(number).alias("rank"))
    before = F.lag("rank").over(Window.orderBy("as_of_date"))  # dates of a calendar, of which there are few
    return problems(dates.withColumn("before", before), ("as_of_date",), {"several splits": F.col("n") > 1, "split before an earlier one": F.col("before") > F.col("rank")})


def input_problems(rows: DataFrame, protocol: str) -> DataFrame:
    """Rows of a dataset with features (row_id, tenant_id, item_id, as_of_date, source_cutoff_date, split, label, quantity_on_hand)
    that break a rule; a row_id given twice is one row here."""
    rows = rows.withColumns({"_n": F.count("*").over(Window.partitionBy("row_id")), "_want": row_id(protocol)})
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = problems(rows, ("row_id",), {
        "empty identity": empty("row_id") | empty("tenant_id") | empty("item_id"), "duplicate row": F.col("_n") > 1, "row identity": F.col("row_id") != F.col("_want"),
        "split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "label": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "source cutoff": ~F.col("source_cutoff_date").eqNullSafe(F.col("as_of_date")), "quantity": F.coalesce("quantity_on_hand", F.lit(-1)) < 0,
    })
    return found.distinct()


def _score_rules() -> dict[str, Column]:
    """Rules of a state: predicted rows have a score in their interval and no reason, abstained ones a reason alone."""
    predicted = F.col("status") == "predicted"
    score, low, high = F.col("score"), F.col("lower"), F.col("upper")
    bad = lambda c: F.isnan(c) | ~c.between(0, 1)
    return {
        "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "predicted state": predicted & (score.isNull() | low.isNull() | high.isNull() | (F.coalesce("abstention_reason", F.lit("")) != "")),
        "score": predicted & bad(score), "uncertainty": predicted & (bad(low) | bad(high) | (low > high)), "uncertainty bounds": predicted & ~score.between(low, high),
        "abstained state": ~predicted & (score.isNotNull() | low.isNotNull() | high.isNotNull()),
        "abstention reason": ~predicted & ~F.coalesce(F.col("abstention_reason").isin(*REASONS), F.lit(False)),
    }


def artifact_problems(predictions: DataFrame, examples: DataFrame, target: str) -> DataFrame:
    """(row_id, problem) of a candidate's predictions (row_id, target, horizon_days, source_cutoff_date, status, score, lower,
    upper, abstention_reason) against the examples (row_id, as_of_date): one prediction an example, each in a valid state."""
    pairs = bijection_problems(predictions, examples, ["row_id"])
    pairs = pairs.withColumn("problem", F.when(F.col("problem") == "missing left", "omitted row").when(F.col("problem") == "missing right", "extra row").otherwise("duplicate row"))
    rows = predictions.join(examples.select("row_id", "as_of_date"), "row_id")
    rules = {"target or horizon": (F.col("target") != target) | (F.col("horizon_days") != HORIZON), "cutoff": ~F.col("source_cutoff_date").eqNullSafe(F.col("as_of_date"))}
    own = problems(rows, ("row_id",), rules | _score_rules()).distinct()
    return pairs.unionByName(own.join(pairs.select("row_id"), "row_id", "left_anti"))


def record_problems(records: DataFrame, target: str, identity: Column) -> DataFrame:
    """(prediction_id, problem) of prediction records before they are stored; ``identity`` is the id that each should have."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    day = F.expr("try_to_date(observation_date, 'yyyy-MM-dd')")
    return problems(records, ("prediction_id",), {
        "identity or target": empty("tenant_id") | empty("item_id") | (F.trim("target") != target), "observation date": day.isNull(),
        "source cutoff": ~F.col("source_cutoff_date").eqNullSafe(F.col("observation_date")), "horizon or predictor": (F.col("horizon_days") != HORIZON) | ~F.col("predictor").isin("baseline", "candidate"),
        **_score_rules(), "prediction identity": F.col("prediction_id") != identity,
    })


def selected_predictor(evaluations: DataFrame) -> DataFrame:
    """The predictor that each evaluation's frozen test outcome gives (outcome, promotion_eligible, beats, baseline, version):
    candidate or baseline; contradictory or incomplete ones have none, but a problem."""
    known = F.coalesce(F.col("baseline").isin("moving_average", "seasonal_naive"), F.lit(False))
    no_version = F.coalesce(F.trim("version"), F.lit("")) == ""
    eligible, beats = (F.coalesce(c, F.lit(False)) for c in ("promotion_eligible", "beats"))
    problem = first_problem({
        "no test outcome": F.col("outcome").isNull(), "candidate is not eligible": (F.col("outcome") == "candidate") & (~eligible | ~beats | F.col("baseline").isNull() | no_version),
        "baseline is contradictory": (F.col("outcome") == "baseline") & (eligible | beats | ~known | no_version), "no predictor": ~F.col("outcome").isin("candidate", "baseline"),
    })
    rows = evaluations.withColumn("problem", problem)
    valid = F.col("problem").isNull()
    return rows.withColumns({"predictor": F.when(valid, F.col("outcome")), "model": F.when(valid, F.when(F.col("outcome") == "baseline", F.col("baseline")).otherwise(F.col("version")))})


def learned_response(requests: DataFrame, artifact: DataFrame) -> DataFrame:
    """Requests (row_id, item_id, observation_date) with the artifact's answer for the row: abstained where the artifact has no
    such row, or has it for another item or date."""
    stored = artifact.select("row_id", F.col("item_id").alias("_item"), F.col("source_cutoff_date").alias("_date"), "status", "score", "abstention_reason")
    rows = requests.join(stored, "row_id", "left")
    same = F.col("_item").eqNullSafe(F.col("item_id")) & F.col("_date").eqNullSafe(F.col("observation_date"))
    return rows.select(
        *requests.columns, F.when(same, F.col("status")).otherwise("abstained").alias("status"), F.when(same, F.col("score")).alias("score"),
        F.when(same, F.col("abstention_reason")).otherwise("unsupported_input").alias("abstention_reason"),
    )


def command_problems(commands: DataFrame, parents: DataFrame, causes: DataFrame) -> DataFrame:
    """(command_id, problem) of commands (command_id, tenant_id, entity_id, parent_id, causation_id; a root has no parent): the
    parent has to exist for the tenant, a root has no cause and every other one its parent's first event, and an entity and a parent are taken once."""
    held = parents.select("tenant_id", F.col("entity_id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    first = causes.groupBy("tenant_id", F.col("entity_id").alias("parent_id")).agg(F.min_by("event_id", "version").alias("_cause"))
    rows = commands.join(held, ["tenant_id", "parent_id"], "left").join(first, ["tenant_id", "parent_id"], "left")
    again = lambda c: F.row_number().over(Window.partitionBy("tenant_id", c).orderBy("command_id")) > 1
    root = F.col("parent_id").isNull()
    rows = rows.withColumns({"_entity": again("entity_id"), "_parent": again("parent_id")})
    return problems(rows, ("command_id",), {
        "empty identity": F.coalesce(F.trim("entity_id"), F.lit("")) == "", "root has a cause": root & F.col("causation_id").isNotNull(), "missing parent": ~root & F.col("_there").isNull(),
        "cause is not the parent's event": ~root & ~F.col("causation_id").eqNullSafe(F.col("_cause")), "entity exists": F.col("_entity"), "parent is taken": ~root & F.col("_parent"),
    })


def accepted_again(stored: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """What becomes of fixture rows that may be there already: insert, keep (the same content) or conflict."""
    old = stored.select(key, F.col(content).alias("_old"), F.lit(True).alias("_there"))
    effect = F.when(F.col("_there").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col(content)), "keep").otherwise("conflict")
    return new.join(old, key, "left").select(*new.columns, effect.alias("effect"))
