"""The corpus pipeline: documents through five operators, each stage written as Parquet and read as the next one's input.

Order: quality classifier, near-duplicates, repeated passages, benchmark decontamination, packing. The first four return
the columns of ``documents``; the last returns the packed pieces (doc_id, piece, n_tokens, bin_id, start).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate, minhash, packing, quality, suffix_dedup
from kinfold.llm.common import materialise
from kinfold.llm.queries import quality_model, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside its held-out fold."""
    return quality.keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that stand earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 words."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each_group),
    ("repeated passages", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
