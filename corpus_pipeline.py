"""The text operators as one pipeline over documents, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from folioflow.llm.queries import tokenizer_file
from folioflow.llm.tables import given, join_on, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# At similarity 0.8, 40 bands of 5 minima miss a pair with probability 1.3e-7.
NEAR = near_dedup.Settings(percent=80, bands=40, minima=256)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return toxicity.drop_toxic(docs, given(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents repeat; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; ids that
    occur in several rows keep them."""
    groups = near_dedup.near_duplicates(docs, NEAR).where("kept").select("doc_id").distinct()
    return join_on(docs, groups, ["doc_id"], "left_semi").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, given(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4,096 tokens."""
    settings = packing.Settings(tokenizer_file("word_bpe_49k.json"), end_id=1, word_level=True)
    return packing.pack(docs, settings)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# Several stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table and read again."""
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
