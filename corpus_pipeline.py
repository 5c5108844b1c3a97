"""The corpus pipeline: toxic documents go, near-duplicates go, repeated passages are cut, sources are mixed, all is packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents;
the last returns packed pieces. Null and empty texts, null ids and sources, repeated rows and extra columns are kept as
the stages' operators say; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.llm.mixing import mixed_documents
from sparktrail.llm.near_copies import without_near_copies
from sparktrail.llm.packing import pack_documents
from sparktrail.llm.store import materialize
from sparktrail.llm.suffix_array import without_repeated
from sparktrail.llm.toxicity import fit, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go; the model learns from the labelled documents among docs.

    The other columns travel in a struct beside the text, so that no name of theirs is taken for one of the scores.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    kept = toxicity(docs.select(rest, "text"), model).filter("toxic_predicted = 0")
    return kept.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 (the stage's name is the contract's)."""
    return without_near_copies(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 and more that occur twice or more are cut out."""
    return without_repeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights 5, 2, 1, repeating; a document is taken three times at most."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as possible."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("suffix_array_dedup", repeats_out),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, hashing and tokenisation are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
