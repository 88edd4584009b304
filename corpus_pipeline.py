"""A corpus pipeline: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm import bpe, jaccard, mixing, secrets, toxicity
from lexsieve.llm.common import table
from lexsieve.llm.queries import TOKENIZER
from lexsieve.sources.shared import settle


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay unless their words raise the odds of the label "toxic" by half or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=model.evidence(1.5)).filter("predicted = 0").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return jaccard.keep_one(docs).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their secrets masked."""
    scanned = secrets.scan_secrets(docs)
    clean = scanned.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets")))
    counted = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return counted.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.take(mixing.mix(docs)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs.select("doc_id", "source", "text"), TOKENIZER).select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens")
    )


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Trained dictionaries and min-hashes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs
