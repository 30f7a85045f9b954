import pytest
from pyspark.sql import functions as F

from cohortflow.operators import splits
from cohortflow.operators.ordering import ranked


def counts(df, col="split"):
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}


def test_ratio_counts_follow_float_arithmetic(spark):
    assert counts(splits.split_ratio(spark.range(1000), "id", 0.8, 1)) == {"train": 800, "val": 99, "test": 101}


def test_fixed_counts(spark):
    assert counts(splits.split_counts(spark.range(300), "id", 1)) == {"test": 200, "train": 80, "val": 20}
    with pytest.raises(Exception, match="at least 280"):
        splits.split_counts(spark.range(279), "id", 1).collect()


def test_rank_is_a_permutation_for_any_partitioning(spark, partitions):
    seen = set()
    for n in (1, 4, 64):
        partitions(n)
        rows = ranked(spark.range(3000).repartition(n), ["id"], 5).orderBy("id").collect()
        assert sorted(r["rank0"] for r in rows) == list(range(3000)) and rows[0]["n_total"] == 3000
        seen.add(tuple(r["rank0"] for r in rows))
    assert len(seen) == 1


def test_rank_within_skewed_groups(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50 + 1))
    for r in ranked(df, ["id"], 5, by=["g"]).groupBy("g").agg(F.max("rank0").alias("m"), F.count("*").alias("n"),
                                                              F.countDistinct("rank0").alias("d"), F.max("n_total").alias("t")).collect():
        assert r["m"] + 1 == r["n"] == r["d"] == r["t"]


def test_random_pick_is_distinct_and_even(spark):
    members = spark.range(60).select(F.when(F.col("id") < 50, 0).otherwise(1).alias("cohort"), F.col("id").alias("node"))
    cands = spark.range(3000).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cohort"))
    picks = splits.pick_random(cands, members, 3, 9)
    per = picks.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("node").alias("d")).collect()
    assert len(per) == 3000 and all(r["n"] == r["d"] == 3 for r in per)
    hits = [r["count"] for r in picks.groupBy("node").count().collect()]
    assert len(hits) == 60 and 100 < min(hits) and max(hits) < 205  # 150 expected each


def test_random_pick_from_a_small_pool(spark):
    members = spark.createDataFrame([(0, 7), (0, 8)], "cohort int, node int")
    picks = splits.pick_random(spark.createDataFrame([(1, 0)], "query_id int, cohort int"), members, 3, 9).collect()
    assert sorted(r["node"] for r in picks) == [7, 8]


def test_resample_draws_exactly_n(spark):
    r = splits.resample(spark.range(200), "id", 30, 4)
    assert {x["s"] for x in r.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()} == {200}
    distinct = r.count() / 30
    assert 115 < distinct < 137  # about 200 * (1 - 1/e)


def test_head_and_tokens(spark):
    df = spark.createDataFrame([(i, "train" if i % 2 else "val", "w " * i) for i in range(10)], "id int, split string, text string")
    assert sorted(r["id"] for r in splits.head_per_split(df, {"train": 2, "val": 1}, "id").collect()) == [0, 1, 3]
    assert sorted(r["id"] for r in splits.filter_by_tokens(df, "text", 3).collect()) == [0, 1, 2, 3]


def test_subgraph_sample(spark):
    nodes = spark.range(100).select(F.col("id").alias("node"), F.when(F.col("id") < 90, 0).otherwise(1).alias("cohort"))
    edges = spark.range(99).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("weight"))
    kept, induced = splits.sample_subgraph(nodes, edges, 40, 3)
    ids = {r["node"] for r in kept.collect()}
    assert len(ids) == 30  # 20 of the first cohort, all 10 of the second
    got = {(r["a"], r["b"]) for r in induced.collect()}
    assert got == {(i, i + 1) for i in range(99) if i in ids and i + 1 in ids}
