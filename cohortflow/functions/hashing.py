"""Seeded hash order and hash-based uniform draws, identical in Spark and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(*parts) -> Column:
    """md5 of the parts joined by ``|``; strings name columns, anything else is a literal."""
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_prefix(key: Column, digits: int) -> Column:
    """The first hex digits of a hash as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """A uniform number in [0, 1): 13 hex digits are 52 bits, all exact in a double."""
    return hash_prefix(hash_key(*parts), 13).cast("double") / F.lit(float(2**52))
