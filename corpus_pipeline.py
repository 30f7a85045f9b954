"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns rows; :func:`run` writes what a stage returns as Parquet in the shared
folder and reads it again as the next one's ``docs``. All stages but the last return the columns of ``documents``.

Nulls, empty and repeated texts are treated as each operator says; an empty table stays empty. The quality rules drop null
and empty texts, the near-dedup stage keeps the smallest id of a group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortflow.llm import decontamination, deobfuscation, fertility, near_dedup, packing
from cohortflow.llm.queries import vocabulary
from cohortflow.session import Scope, work_folder

ORACLE_SQL = None  # tokenisers and sketches are beyond SQL; tests hold each stage against brute force

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep."""
    return fertility.good(docs, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by their kind; n_chars counts the new text."""
    out = deobfuscation.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage wrote for itself go when its result is stored; those of the last stage stay,
    as its rows are read from them, and so do stored results, each run's in a folder of its own."""
    folder = f"{work_folder(spark)}/cohortflow/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
