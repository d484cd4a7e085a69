"""Strict JSON documents: artifacts, requests and responses that cross into or out of a predictor.

A text is parsed once, to a VARIANT, and walked by native expressions along a shape: no Python, no second parse. A shape
is a kind ("string", "integer", "number"), a dict of members for an object, or a list with one shape for an array. As in
the contract, unknown members and anything after the document are refused and so is a value of another kind; a member
that is missing or null is its kind's zero, which the rules on values judge.

The parser stops behind the first document and would let text follow. So the text is parsed twice over: as the only element of
an array, and as the only member of an object; whatever closes one of these early cannot close the other. A repeated
member is refused too, where the contract lets the last one count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Members of the candidate's artifact, of a prediction in it, and of a predictor's response.
UNCERTAINTY = {"method": "string", "lower": "number", "upper": "number", "sample_count": "integer"}
PREDICTION = {
    "row_id": "string", "target": "string", "horizon_days": "integer", "source_cutoff_date": "string", "status": "string", "stockout_risk": "number", "uncertainty": UNCERTAINTY, "abstention_reason": "string",
}
ARTIFACT = {
    "artifact_version": "integer", "model_version": "string", "code_version": "string", "evaluation_protocol_version": "string", "dataset_version": "string", "dataset_checksum": "string", "feature_definition_version": "string",
    "feature_snapshot_id": "string", "feature_snapshot_checksum": "string", "target": "string", "horizon_days": "integer", "training_split": "string", "tuning_split": "string", "predictions": [PREDICTION],
}
RESPONSE = {
    "contract_version": "integer", "predictor": "string", "tenant_id": "string", "item_id": "string", "row_id": "string", "observation_date": "string", "source_cutoff_date": "string", "target": "string", "horizon_days": "integer",
    "feature_definition_version": "string", "feature_snapshot_id": "string", "feature_snapshot_checksum": "string", "model_version": "string", "code_version": "string", "status": "string", "stockout_risk": "number",
    "uncertainty": UNCERTAINTY, "abstention_reason": "string",
}
ABSTENTIONS = ("insufficient_support", "unsupported_input", "insufficient_feature_history")
#: How the parser names the kinds' values; decimals are how it keeps short fractions.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*"}
_TYPES = {"string": "string", "integer": "bigint", "number": "double"}


def document(text: Column) -> Column:
    """The VARIANT of a text that is one JSON document, else null."""
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(element, "$[1]", "variant").isNull() & F.try_variant_get(element, "$[0]", "variant").isNotNull()
    return F.when(alone & member.isNotNull(), F.try_variant_get(element, "$[0]", "variant"))


def misfit(value: Column, shape, path: str = "") -> Column:
    """The first member that does not fit, in the shape's order, with what is wrong; null if all do. A null value fits."""
    kind = F.schema_of_variant(value)
    here = path or "document"
    if isinstance(shape, str):
        wrong = F.when(~kind.rlike(f"^({_KINDS[shape]})$"), F.lit(f"{here}: not {'an' if shape[0] == 'i' else 'a'} {shape}"))
    elif isinstance(shape, list):
        found = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: misfit(x, shape[0], f"{here}[]"))
        wrong = F.when(~kind.startswith("ARRAY"), F.lit(f"{here}: not an array")).otherwise(F.get(F.array_compact(found), F.lit(0)))
    else:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        unknown = F.get(F.array_sort(F.filter(F.map_keys(members), lambda k: ~k.isin(*shape))), F.lit(0))
        dot = f"{path}." if path else ""
        inner = [misfit(F.try_variant_get(value, f"$.{name}", "variant"), own, dot + name) for name, own in shape.items()]
        wrong = F.when(~kind.startswith("OBJECT"), F.lit(f"{here}: not an object")).when(unknown.isNotNull(), F.concat(F.lit(f"{here}: unknown member "), unknown)).otherwise(F.coalesce(*inner))
    return F.when(value.isNotNull() & (kind != "VOID"), wrong)


def strict(rows: DataFrame, shape: dict, column: str = "value") -> DataFrame:
    """``rows`` with the shape's members of one kind as columns, and the problem of a document that is refused."""
    read = rows.withColumn("_v", document(F.col(column)))
    problem = F.when(F.col("_v").isNull(), "not one JSON document").otherwise(misfit(F.col("_v"), shape))
    read = read.withColumn("problem", problem)
    taken = [F.when(F.col("problem").isNull(), F.try_variant_get("_v", f"$.{name}", _TYPES[kind])).alias(name) for name, kind in shape.items() if isinstance(kind, str)]
    return read.select(*rows.columns, *taken, "problem", F.when(F.col("problem").isNull(), F.col("_v")).alias("document"))


def predictions(artifacts: DataFrame, *keep: str) -> DataFrame:
    """The predictions of accepted artifacts (``document``), a row each, missing values as their zeros, bounds as null if
    there is no uncertainty."""
    each = artifacts.where("problem IS NULL").select(*keep, F.explode(F.try_variant_get("document", "$.predictions", "array<variant>")).alias("p"))
    member = lambda name, kind: F.try_variant_get("p", f"$.{name}", kind)
    zero = {"string": F.lit(""), "integer": F.lit(0).cast("long")}
    own = [F.coalesce(member(n, _TYPES[k]), zero[k]).alias(n) for n, k in PREDICTION.items() if isinstance(k, str) and k in zero]
    return each.select(*keep, *own, member("stockout_risk", "double").alias("score"), member("uncertainty.lower", "double").alias("lower"), member("uncertainty.upper", "double").alias("upper"), member("uncertainty.sample_count", "bigint").alias("sample_count"))


def response_problem(request: tuple[str, ...]) -> Column:
    """What is wrong with a response (columns of ``RESPONSE``, and its ``document``) to a request, whose columns of the same
    names begin with ``request_``: its lineage first, then the rules of its status."""
    other = F.exists(F.array(*(~F.col(c).eqNullSafe(F.col(f"request_{c}")) for c in request)), lambda x: x) | ~F.col("source_cutoff_date").eqNullSafe(F.col("request_observation_date"))
    bound = lambda name: F.try_variant_get("document", f"$.uncertainty.{name}", "double")
    uncertain = F.coalesce(F.schema_of_variant(F.try_variant_get("document", "$.uncertainty", "variant")).startswith("OBJECT"), F.lit(False))
    risk, reason, low, high = F.col("stockout_risk"), F.coalesce("abstention_reason", F.lit("")), F.coalesce(bound("lower"), F.lit(0.0)), F.coalesce(bound("upper"), F.lit(0.0))
    predicted = (
        F.when(risk.isNull() | ~uncertain | (reason != ""), "predicted response").when(F.isnan(risk) | (risk < 0) | (risk > 1), "score")
        .when((low < 0) | (high > 1) | (low > risk) | (high < risk), "uncertainty bounds")
    )
    abstained = F.when(risk.isNotNull() | uncertain | ~reason.isin(*ABSTENTIONS), "abstained response")
    status = F.coalesce("status", F.lit(""))
    return F.when(F.col("problem").isNotNull(), F.col("problem")).when(other, "response lineage").when(status == "predicted", predicted).when(status == "abstained", abstained).otherwise("response status")
