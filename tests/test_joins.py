import pytest
from pyspark.sql import functions as F

from cohortflow.operators import grids, joins


@pytest.mark.parametrize("how", ["inner", "left"])
def test_crowded_keys_are_salted(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1010, None).otherwise(F.col("id") % 90).alias("k"), "id")
    small = spark.createDataFrame([(i, i * 2) for i in range(80)], "k bigint, v bigint")
    crowd = joins.crowded_keys(big, "k", 500)
    assert crowd.size == 1 and [tuple(r) for r in crowd.keys.collect()] == [(7, 3)]
    got = joins.join_per_key(big, small, "k", how, rows=500)
    want = big.join(small, "k", how)
    order = lambda df: sorted(map(tuple, df.select("id", "k", "v").collect()))
    assert order(got) == order(want)


def test_clipping_with_a_crowded_stay(spark, monkeypatch):
    obs = spark.range(2000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 40 + 2).alias("stay_id"),
                                   F.col("id").alias("row_no"), (F.col("id") % 500 / 10.0).alias("hours"), F.lit("c").alias("channel"), F.lit("1").alias("raw"))
    labels = spark.range(1, 42).select(F.col("id").alias("stay_id"), (F.col("id") + 5.0).alias("t"))
    plain = sorted(r["row_no"] for r in grids.clip_to_bound(obs, labels).collect())
    real = joins.crowded_keys
    monkeypatch.setattr(grids, "crowded_keys", lambda df, key: real(df, key, 500))
    split = sorted(r["row_no"] for r in grids.clip_to_bound(obs, labels).collect())
    assert plain == split and 0 < len(plain) < 2000
