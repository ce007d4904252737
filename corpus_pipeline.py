"""A corpus pipeline of five stages over ``documents``, each one operator of tidemark.llm.

Every stage takes what the stage before kept, written as Parquet and read again. All but the last return the
columns of ``documents``; the last returns the mix: the kept documents with the words that the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, near_dup, pii, toxicity
from tidemark.llm.common import discard, materialise, table, unused


def only(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key`` is (left_semi) or is not (left_anti) in the first column of ``ids``. Whole
    rows travel as one column, so that none of theirs can clash with it."""
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"))
    return rows.join(ids.toDF("id"), F.col("key") == F.col("id"), how).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold by a model from all labels. Null texts, texts of any length,
    repeated rows and rows without doc_id are scored and kept like others, further columns stay whatever their names;
    an empty table stays empty; without labels all are kept."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = unused("score", docs.columns)
    scored = toxicity.score(docs, model, *docs.columns, name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 or more the one with the smallest doc_id, once.

    Documents without words and rows without doc_id are linked with nothing and kept. Rows that share a doc_id are
    told apart: equal texts are copies, different ones stay. Very long texts count whole, further columns stay
    whatever their names; an empty table stays empty."""
    repeated = not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    key = unused("row_number", docs.columns) if repeated else "doc_id"
    if repeated:  # rows numbered in the order of doc_id stand for the ids
        docs = docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(key, F.monotonically_increasing_id())
        docs = materialise(docs, "numbered")
    named = docs.select(F.when(F.col("doc_id").isNotNull(), F.col(key)).alias("doc_id"), "text")
    found = near_dup.near_duplicates(named, percent=80)
    gone = materialise(found.where(~F.col("kept")).select("doc_id"), "gone")
    kept = only(docs, gone, "left_anti", key)
    return kept.drop(key) if repeated else kept


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as such or with other numbers, names or units. Null texts and rows
    without doc_id hold none; rows that share a doc_id go or stay together. Very long texts are searched whole,
    further columns stay whatever their names; an empty table stays empty."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return only(docs, found.select("doc_id").distinct(), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows where a text changed. A null
    text stays null, repeated rows and rows without doc_id are rows like others. Very long texts are masked whole,
    further columns stay whatever their names; an empty table stays empty, and one without n_chars gets none."""
    if "n_chars" not in docs.columns:
        return pii.mask_pii(docs)
    before = unused("_before", docs.columns)
    out = pii.mask_pii(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).drop(before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken, which replace columns of
    these names. Null and empty texts have no words and go; a null source is one of its own; repeated rows share
    what is taken of them. Very long texts count whole; an empty table stays empty."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table documents; a stage's table is deleted when the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs


#: Trained models, sketches and keyed hashes are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None
