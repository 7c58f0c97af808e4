"""A corpus pipeline of operators of tessera.llm: each stage takes all rows that the one before it kept.

run() applies the stages to the table documents. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tessera.llm.common import checkpoint_dir, dropped, free_name, passing, shuffles_freed, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that are not toxic stay."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later ones of similar lines are cut from the texts; a document that loses all its words goes. n_chars follows the text."""
    removed = F.col(free_name(docs, "n_removed"))
    left = line_dedup.dedup_lines(docs).where((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(removed == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest id; texts without words stay."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the documents in length buckets and batches."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Training a scorer and banded alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage needed, and what the one before it returned, goes when it is written; so the disk holds one stage at a time."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}-{name}"
        with passing(spark), shuffles_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
