"""Training rows for the classifiers: a bounded, deterministic sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3 (null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled documents that aren't held out, chosen by a hash of doc_id.

    Null labels and null ids don't take part; of an id with several labels the largest counts, of one with several
    documents the smallest text, so that the rows are at most `limit`. The ids are broadcast, and the texts of other
    documents are not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y")).select("text", "y")
