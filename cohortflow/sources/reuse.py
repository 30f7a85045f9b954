"""A store of computed columns by text, of which only new texts are computed.

The store is a folder of parts (Parquet, one row for each distinct text, keyed by the text's md5) and a manifest. A version of
the manifest names its parts and is written after them, by Spark's own job commit, so a reader sees whole versions, and a job
that failed leaves a part that no version names. Of two jobs that commit at once the later version counts; what the other
one computed is computed again when it is asked for.

A null text counts as an empty one. Repeated texts are computed once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

KEY = "text_md5"


def text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def _manifest(spark: SparkSession, base: str) -> tuple[int, list[str]]:
    """The last version and its parts: one row, as many names as runs since the last :func:`compact`."""
    try:
        last = spark.read.schema("version long, parts array<string>").json(f"{base}/manifest").orderBy(F.desc("version"), "parts").first()
    except AnalysisException:
        last = None
    return (last["version"], list(last["parts"])) if last else (0, [])


def _commit(spark: SparkSession, base: str, version: int, parts: list[str]) -> None:
    row = spark.createDataFrame([(version, parts)], "version long, parts array<string>")
    row.coalesce(1).write.mode("append").json(f"{base}/manifest")


def stored(spark: SparkSession, base: str) -> DataFrame | None:
    """All rows of the last version, None if there is none."""
    _, parts = _manifest(spark, base)
    return spark.read.parquet(*[f"{base}/{p}" for p in parts]) if parts else None


def fill(docs: DataFrame, text_col: str, base: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Compute what the store lacks for these texts; the number of texts that were computed.

    ``compute`` gets ``(text_md5, text)`` of distinct texts and returns ``text_md5`` with the new columns.
    """
    spark, base = docs.sparkSession, base.rstrip("/")
    version, parts = _manifest(spark, base)
    known = stored(spark, base)
    texts = docs.select(text_key(text_col).alias(KEY), F.coalesce(text_col, F.lit("")).alias("text"))
    if known is not None:  # before copies are sorted out: known texts need no shuffle of theirs
        texts = texts.join(known.select(KEY), KEY, "left_anti")
    watch, part = Observation(), f"part-{uuid.uuid4().hex}"
    compute(texts.dropDuplicates([KEY])).observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/{part}")
    n = watch.get["n"]
    if n or not parts:
        _commit(spark, base, version + 1, [*parts, part])
    return n


def with_stored(docs: DataFrame, text_col: str, base: str) -> DataFrame:
    """``docs`` with the store's columns, null where the store lacks a text."""
    found = stored(docs.sparkSession, base.rstrip("/"))
    if found is None:
        raise ValueError(f"nothing is stored in {base}")
    clash = [c for c in found.columns if c in docs.columns]
    if clash:
        raise ValueError(f"columns {clash} are in the store and in the table")
    return docs.join(found, text_key(text_col) == found[KEY], "left").drop(KEY)


def compact(spark: SparkSession, base: str, used: DataFrame | None = None, text_col: str = "text") -> None:
    """One part instead of many, of the texts in ``used`` alone if it is given. Older parts stay for readers of their versions."""
    base = base.rstrip("/")
    version, parts = _manifest(spark, base)
    if not parts:
        return
    rows, part = stored(spark, base), f"part-{uuid.uuid4().hex}"
    if used is not None:
        rows = rows.join(used.select(text_key(text_col).alias(KEY)), KEY, "left_semi")
    rows.write.parquet(f"{base}/{part}")
    _commit(spark, base, version + 1, [part])
