"""Joins with a table of one row per key, safe for keys that hold a large share of the rows.

A plain shuffle join sends all rows of a key to one task, and a grouping by the same key afterwards keeps
them there, out of reach of the runtime skew handling. Here the crowded keys are counted first, in a table;
their rows are dealt to salts, as many as the key is crowded, and the one partner row is copied to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written_with

CROWDED_ROWS = 1_000_000


class Crowd:
    """Crowded keys and their salts. There is one key for ``rows`` rows at most, which bounds the table that is broadcast."""

    def __init__(self, keys: DataFrame, size: int):
        self.keys, self.size = keys, size


def crowded_keys(df: DataFrame, key: str, rows: int = CROWDED_ROWS) -> Crowd:
    """Keys with at least ``rows`` rows, each with a salt for every ``rows`` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= rows) & F.col(key).isNotNull())
    keys, seen = written_with(counts.select(key, F.ceil(F.col("n") / rows).cast("int").alias("_salts")), "crowd", n=F.count(F.lit(1)))
    return Crowd(keys, seen["n"] or 0)


def join_per_key(big: DataFrame, small: DataFrame, key: str, how: str = "inner", crowded: Crowd | None = None,
                 rows: int = CROWDED_ROWS) -> DataFrame:
    """``big.join(small, key, how)`` for inner or left joins, ``small`` having one row per key."""
    if crowded is None:
        crowded = crowded_keys(big, key, rows)
    if not crowded.size:
        return big.join(small, key, how)
    salts = F.broadcast(crowded.keys)
    dealt = F.coalesce(F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.col("_salts")).cast("int"), F.lit(0))
    left = big.join(salts, key, "left").withColumn("_salt", dealt).drop("_salts")
    right = small.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup(df: DataFrame, dim: DataFrame, key: str, max_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """Left join with a settings table: broadcast when its texts and numbers take at most ``max_bytes``, else by key."""
    wide = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in dim.columns), F.lit(16)).cast("long"))
    size = dim.agg(wide.alias("b")).first()["b"] or 0
    if size <= max_bytes:
        return df.join(F.broadcast(dim), key, "left")
    return join_per_key(df, dim, key, "left")
