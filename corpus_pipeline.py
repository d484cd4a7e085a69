"""The training-data pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

The language model of the first stage is fitted on the documents it is given, its labels are the table
beside them. Personal data are replaced in the texts by their kind in angle brackets. The last stage
returns the pieces of the remaining documents and their places in sequences.

Empty inputs pass through all stages; null texts are no toxic documents, but fail the quality rules. Of a
group of near copies one row stays: the one with the smallest doc_id, of equal ones that with the smallest
hash of its text; null doc_ids come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import op2_quality_rules, op5_pii, op8_best_fit_packing, op9_jaccard_join, op10_toxicity
from eventfold.llm.common import Written, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    learned = op10_toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return op10_toxicity.score(docs.select(*COLUMNS), learned).where("predicted = 0").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return op2_quality_rules.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows, and all rows without words.

    Rows get ids of their own for the join, so null and repeated doc_ids are rows like others. Of each group the
    smallest row by (doc_id, hash of the text) stays, null doc_ids last.
    """
    written = Written(spark, "near-copies")
    rows = written.put(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = op9_jaccard_join.join_copies(rows.select(F.col("_row").alias("doc_id"), "text"))
    groups = written.put(found.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    members = written.put(rows.select("_row", "doc_id", F.sha2("text", 256).alias("_text")).join(groups, "_row"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text", "_row")).alias("first")
    stay = members.groupBy("_group").agg(first).select(F.col("first._row").alias("_row"))
    others = written.put(members.select("_row").join(stay, "_row", "left_anti"), "others")
    others = F.broadcast(others) if others.count() <= op9_jaccard_join.BROADCAST_IDS else others
    return rows.join(others, "_row", "left_anti").select(*COLUMNS)


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted again."""
    docs = docs.select(*COLUMNS)
    return op5_pii.redact(docs, op5_pii.learn(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places."""
    import public_tokenizers

    return op8_best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("private_spans", private_spans),
    ("packing", packing),
]
#: Toxicity and packing have no SQL; the near copies are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    written = Written(spark, "pipeline")
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = written.put(stage(spark, docs, sf_dir), name)
    return docs
