"""The stages that turn raw documents into packed training sequences, applied one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import jaccard, packing, quality, secrets, substrings
from tagloom.llm.common import read, settle_table
from tagloom.llm.queries import vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their host's verdict."""
    return quality.keep_good(docs)


def one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five words, similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id has."""
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = substrings.dedup_substrings(docs)
    return found.select(*columns, F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars")).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 token ids."""
    return packing.piece_rows(packing.pack(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality rules", good), ("n-gram Jaccard join", one_of_alike), ("substring dedup", without_repeats),
    ("secret scans", without_secrets), ("packing", packed),
]

# Segmentation by guess cost, token ids and sketches have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
