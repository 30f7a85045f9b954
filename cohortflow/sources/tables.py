"""Prepared tables, content fingerprints, stored embeddings, metric files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import hash_key, hash_prefix


def prepared_path(base: str, dataset: str, seed: int, period: int) -> str:
    """One key for writing and reading."""
    return f"{base.rstrip('/')}/{dataset}/seed{seed}_period{period}"


def write_prepared(df: DataFrame, base: str, dataset: str, seed: int, period: int) -> str:
    """Parquet, one folder per split."""
    path = prepared_path(base, dataset, seed, period)
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_prepared(spark: SparkSession, base: str, dataset: str, seed: int, period: int) -> DataFrame:
    return spark.read.parquet(prepared_path(base, dataset, seed, period))


def fingerprint(df: DataFrame, id_col: str, text_col: str, split_col: str) -> DataFrame:
    """Digest of the texts per split: ``(split, n, digest)``.

    Rows are hashed with their id, row hashes are folded inside 65536 hash pieces and the piece digests in
    piece order, so no task holds all hashes of a split.
    """
    rows = df.select(
        F.col(split_col).alias("split"), hash_prefix(hash_key(F.col(id_col)), 4).alias("piece"),
        F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit(""))))).alias("h"))
    pieces = rows.groupBy("split", "piece").agg(
        F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("d"))
    folded = F.array_sort(F.collect_list(F.struct("piece", "d")))
    return pieces.groupBy("split").agg(F.sum("n").alias("n"), folded.alias("f")).select(
        "split", "n", F.md5(F.array_join(F.transform("f", lambda s: s["d"]), "")).alias("digest"))


def cache_key(prints: DataFrame, config: dict) -> str:
    """One md5 over a configuration and the fingerprints of a few splits."""
    parts = [f"{r['split']}:{r['n']}:{r['digest']}" for r in prints.orderBy("split").collect()]  # one row per split
    spark = prints.sparkSession
    text = json.dumps(config, sort_keys=True) + "".join(parts)
    return spark.range(1).select(F.md5(F.lit(text))).first()[0]


def cached(spark: SparkSession, base: str, key: str, needed: list[str], compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored table of this key, or the computed one after storing it; a table without ``needed`` is refused."""
    path = f"{base.rstrip('/')}/{key}"
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        compute().write.parquet(path)
        found = spark.read.parquet(path)
    missing = [c for c in needed if c not in found.columns]
    if missing:
        raise KeyError(f"stored table {path} lacks columns {missing}; it has {found.columns}")
    return found


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    df.write.mode("overwrite").json(path)
