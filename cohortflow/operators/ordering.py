"""A global rank without a single-task sort, and range pieces for cumulative sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_key, hash_prefix
from ..session import written

HASH_DIGITS = 4  # 65536 pieces


def ranked(df: DataFrame, ids, seed, by=(), rank: str = "rank0", total: str = "n_total") -> DataFrame:
    """Add the 0-based rank in seeded hash order and the group size.

    Rows are spread over hash pieces, ranked inside a piece and shifted by the size of the pieces before
    it. The piece table holds at most 65536 rows per group, and hashes are even, so neither a hot group
    nor the whole table ever lands in one task.
    """
    ids, by = list(ids), list(by)
    keyed = df.withColumn("_key", hash_key(*ids, seed)).withColumn("_piece", hash_prefix(F.col("_key"), HASH_DIGITS))
    slim = df.select(*by, hash_prefix(hash_key(*ids, seed), HASH_DIGITS).alias("_piece"))
    pieces = slim.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    before = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *by, "_piece",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most 65536 rows
    inside = Window.partitionBy(*by, "_piece").orderBy("_key", *ids)
    return (keyed.withColumn("_at", F.row_number().over(inside) - 1)
            .join(offsets, [*by, "_piece"])
            .withColumn(rank, F.col("_before") + F.col("_at"))
            .drop("_key", "_piece", "_at", "_before"))


def first_n(df: DataFrame, by, order, n: int) -> DataFrame:
    """The first ``n`` rows of each group in the order of the columns ``order``.

    Each group is first cut into as many parts as the session has shuffle partitions, by a hash of its rows, and only the
    first n of a part go on; so a group with most of the rows is ranked by all tasks. What one task then ranks is n rows
    a part.
    """
    by, order = list(by), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [f"_{x}{i}" for i, x in enumerate(("part", "at"))]
    few = df.withColumn(own[0], F.pmod(F.xxhash64(*order), F.lit(parts)))
    for keys in ([*by, own[0]], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        few = few.withColumn(own[1], rank).filter(F.col(own[1]) <= n)
    return few.drop(*own)


def numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """Add the 0-based place of each row in the order of ``col``, which has no repeats: ranges are sorted on their own and
    shifted by the rows before them."""
    ranges = written(df.repartitionByRange(F.col(col)).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(col)) - 1
    return ranges.withColumn("_at", place).join(starts, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def range_edges(df: DataFrame, col: str, pieces: int | None = None) -> list[float]:
    """Ascending quantiles of a column that cut it into about equal pieces.

    One pass with a bounded quantile sketch. The edges only balance the work; results never depend on them.
    """
    if pieces is None:
        pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if pieces < 2:
        return []
    cuts = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(col, cuts, 4 * pieces).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_piece(c: Column, edges: list[float]) -> Column:
    """Number of edges below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < c))
