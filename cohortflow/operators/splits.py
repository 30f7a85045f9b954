"""Splits, samples and bootstrap draws in seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import hash_key, hash_uniform
from .ordering import first_n, ranked


def ordered(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Position of every row in the seeded order (``rank0``) and the row count (``n_total``)."""
    return ranked(df, [id_col], seed)


def split_ratio(df: DataFrame, id_col: str, ratio: float, seed: int) -> DataFrame:
    """Exact train/val/test counts: int(N*r), int(N*((1-r)/2)), the rest.

    The counts follow double arithmetic: with N=1000 and r=0.8 the middle part has 99 rows, not 100.
    """
    n_train = F.floor(F.col("n_total") * F.lit(ratio))
    n_val = F.floor(F.col("n_total") * F.lit((1 - ratio) / 2))
    return (ranked(df, [id_col], seed)
            .withColumn("split", F.when(F.col("rank0") < n_train, "train")
                        .when(F.col("rank0") < n_train + n_val, "val").otherwise("test"))
            .drop("rank0", "n_total"))


def split_counts(df: DataFrame, id_col: str, seed: int, test: int = 200, train: int = 80) -> DataFrame:
    """Fixed test and train counts, the rest is val; too few rows is an error."""
    short = F.concat(F.lit(f"need at least {test + train} rows, found "), F.col("n_total").cast("string"))
    return (ranked(df, [id_col], seed)
            .withColumn("split", F.when(F.col("n_total") < test + train, F.raise_error(short))
                        .when(F.col("rank0") < test, "test")
                        .when(F.col("rank0") < test + train, "train").otherwise("val"))
            .drop("rank0", "n_total"))


def head_per_split(df: DataFrame, sizes: dict[str, int], order_col: str, split_col: str = "split") -> DataFrame:
    """The first n rows of each named split."""
    limit = F.try_element_at(F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv]), F.col(split_col))
    top = max(sizes.values())
    few = first_n(df.filter(limit.isNotNull()), [split_col], [order_col], top)
    w = Window.partitionBy(split_col).orderBy(order_col)  # over the first ``top`` rows of each split
    return few.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def token_count(c):
    """Words separated by white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))


def filter_by_tokens(df: DataFrame, text_col: str, n: int, counter=token_count) -> DataFrame:
    """Rows whose text has at most ``n`` tokens; ``counter`` may be a pandas UDF with a subword count."""
    return df.filter(counter(F.col(text_col)) <= n)


def dropped_by_tokens(df: DataFrame, text_col: str, n: int, split_col: str = "split", counter=token_count) -> DataFrame:
    """Rows before and after :func:`filter_by_tokens`, per split."""
    keep = counter(F.col(text_col)) <= n
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(~F.coalesce(keep, F.lit(False))).alias("n_dropped"),
    )


def pick_random(cands: DataFrame, members: DataFrame, n: int, seed: int) -> DataFrame:
    """Up to ``n`` members of each query's candidate cohorts, uniform without replacement.

    ``cands(query_id, cohort)``, ``members(cohort, node)`` -> ``(query_id, rank, node)``. Floyd's sampling
    draws ``n`` distinct positions among the pool of a query; positions are looked up by (cohort, rank), so
    no list of all (query, member) pairs is made, whatever the size of a cohort.
    """
    placed = ranked(members.select("cohort", "node"), ["node"], seed, by=["cohort"], rank="pos", total="size")
    sizes = members.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    per_query = Window.partitionBy("query_id").orderBy("cohort")
    pool = cands.select("query_id", "cohort").join(sizes, "cohort").select(
        "query_id", "cohort", "size",
        (F.sum("size").over(per_query.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        F.sum("size").over(Window.partitionBy("query_id")).alias("pool_size"),
    )
    drawn = pool.select("query_id", "pool_size").distinct().withColumn(
        "picks", F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)), F.expr("cast(array() as array<bigint>)"),
            lambda acc, i: _floyd_step(acc, i, n, seed)))
    picks = drawn.select("query_id", F.posexplode("picks").alias("at", "target")).withColumn("rank", F.col("at") + 1)
    hits = (picks.join(pool, "query_id")
            .filter((F.col("target") >= F.col("start")) & (F.col("target") < F.col("start") + F.col("size")))
            .select("query_id", "rank", "cohort", (F.col("target") - F.col("start")).alias("pos")))
    return hits.join(placed.select("cohort", "pos", "node"), ["cohort", "pos"]).select("query_id", "rank", "node")


def _floyd_step(acc, i, n, seed):
    high = F.col("pool_size") - F.least(F.lit(n), F.col("pool_size")) + i
    draw = F.floor(hash_uniform("query_id", i, seed) * (high + 1)).cast("bigint")
    grown = F.concat(acc, F.array(F.when(F.array_contains(acc, draw), high).otherwise(draw)))
    return F.when(high < F.col("pool_size"), grown).otherwise(acc)


def sample_subgraph(nodes: DataFrame, edges: DataFrame, max_nodes: int, seed: int):
    """Cohort-stratified node sample of min(size, max_nodes // n_cohorts) and its induced edges.

    ``nodes(node, cohort)``, ``edges(a, b, weight)`` -> (nodes, edges).
    """
    cohorts = nodes.agg(F.countDistinct("cohort").alias("k")).first()["k"]
    quota = max_nodes // max(cohorts, 1)
    kept = first_n(nodes.withColumn("_key", hash_key("node", seed)), ["cohort"], ["_key", "node"], quota).drop("_key")
    ends = kept.select("node")
    induced = (edges.join(ends.withColumnRenamed("node", "a"), "a", "left_semi")
               .join(ends.withColumnRenamed("node", "b"), "b", "left_semi"))
    return kept, induced.select("a", "b", "weight")


def resample(df: DataFrame, id_col: str, draws: int, seed: int) -> DataFrame:
    """Bootstrap: ``draws`` times N draws with replacement, as ``(replicate, id, weight)``.

    Draw j of replicate b picks the row at position floor(u(b, j) * N) of the seeded order. Equal draws are
    counted before the join, so the join sees one row per (replicate, picked row).
    """
    spark = df.sparkSession
    base = df.select(id_col)
    n = base.count()
    at = F.floor(hash_uniform("replicate", "draw", seed) * F.lit(n)).cast("bigint")
    picks = (spark.range(draws * n)
             .select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("replicate"), (F.col("id") % F.lit(max(n, 1))).alias("draw"))
             .select("replicate", at.alias("rank0"))
             .groupBy("replicate", "rank0").agg(F.count(F.lit(1)).alias("weight")))
    places = ranked(base, [id_col], seed).select("rank0", id_col)
    return picks.join(places, "rank0").select("replicate", id_col, "weight")
