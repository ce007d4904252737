"""Bounded samples of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """text and label (0 or 1) of at most ``most`` labelled documents for which ``learn`` (over doc_id) holds,
    those with the smallest hashes of their ids; a repeated doc_id has its highest label and its first text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # so it may be broadcast: two numbers a row
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
