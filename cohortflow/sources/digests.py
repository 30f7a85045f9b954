"""Digests of whole tables that can be added, taken away and compared by key ranges.

A row's hash is cut into four numbers of 32 bits, and a range of keys has the sums of its rows' numbers modulo 2^32. Sums do
not depend on order or partitioning, are combined map-side, and count repeated rows as often as they are there. So the
digest of an appended part is added to the stored one without reading the old rows, and nothing gathers hashes.

Ranges are prefixes of the id's md5, so shorter prefixes form a tree with 16 children a node. Two tables are compared from
the top; only children of nodes that differ are looked at, and only rows of differing ranges are read for the changes.

A null id counts as an empty one; a null text differs from an empty one. An empty table has no ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_prefix

LANES = ("a", "b", "c", "d")
DIGITS = 3  # 4096 ranges; one more for each sixteenfold growth


def _key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def _row(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(text_col)), F.lit(""))))


def _summed(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("n").alias("n"), *[F.pmod(F.sum(x), F.lit(2**32)).alias(x) for x in LANES])


def range_digests(df: DataFrame, id_col: str, text_col: str, digits: int = DIGITS) -> DataFrame:
    """``(range, n, a, b, c, d)`` of every range of keys that has rows."""
    rows = df.select(F.substring(_key(id_col), 1, digits).alias("range"), _row(id_col, text_col).alias("h"))
    lanes = [hash_prefix(F.substring("h", 8 * i + 1, 8), 8).alias(x) for i, x in enumerate(LANES)]
    return _summed(rows.select("range", F.lit(1).cast("bigint").alias("n"), *lanes), "range")


def merge_digests(first: DataFrame, *more: DataFrame, less: DataFrame | None = None) -> DataFrame:
    """Digests of the rows of all parts together, without those of ``less``; ranges left without rows are left out."""
    parts = [first, *more]
    if less is not None:
        parts.append(less.select("range", *[(-F.col(x)).alias(x) for x in ("n", *LANES)]))
    return _summed(reduce(DataFrame.unionByName, parts), "range").where("n <> 0")


def digest_tree(ranges: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``(level, node, n, a, b, c, d)``: sums of all prefixes, level 0 being the whole table. Store it partitioned by level."""
    level = ranges.withColumnRenamed("range", "node")
    out = [level.withColumn("level", F.lit(digits))]
    for k in range(digits - 1, -1, -1):
        level = _summed(level.withColumn("node", F.substring("node", 1, k)), "node")
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select("level", "node", "n", *LANES)


def changed_ranges(old: DataFrame, new: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``range``: the ranges in which two trees of :func:`digest_tree` differ."""
    differ = None
    for k in range(digits + 1):
        sides = [t.where(F.col("level") == k).select("node", F.struct("n", *LANES).alias(x)) for t, x in ((old, "was"), (new, "is"))]
        if differ is not None:
            parent = differ.withColumnRenamed("node", "parent")
            sides = [t.join(parent, F.substring(t["node"], 1, k - 1) == F.col("parent"), "left_semi") for t in sides]
        differ = sides[0].join(sides[1], "node", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("node")
    return differ.withColumnRenamed("node", "range")


def changed_rows(old: DataFrame, new: DataFrame, ranges: DataFrame, id_col: str, text_col: str, digits: int = DIGITS) -> DataFrame:
    """``(id, change)``: ids of these ranges with rows that were ``added``, ``removed`` or ``changed``."""
    def side(df, sign):
        rows = df.select(F.col(id_col), F.substring(_key(id_col), 1, digits).alias("range"), _row(id_col, text_col).alias("h"))
        return rows.join(ranges, "range", "left_semi").select(id_col, "h", F.lit(sign).alias("sign"))

    apart = side(old, -1).unionByName(side(new, 1)).groupBy(id_col, "h").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    of = apart.groupBy(id_col).agg(F.min("sign").alias("low"), F.max("sign").alias("high"))
    change = F.when(F.col("low") > 0, "added").when(F.col("high") < 0, "removed").otherwise("changed")
    return of.select(id_col, change.alias("change"))
