import pytest
from pyspark.sql import functions as F

from cohortflow.operators import grids
from cohortflow.plans import catalogue, prepare

SCHEMA = "stay_id string, row_no int, hours double, channel string, raw string"


def obs(spark, rows):
    """rows: (hours, raw) of one stay and one channel."""
    return spark.createDataFrame([("s", i, float(h), "c", v) for i, (h, v) in enumerate(rows)], SCHEMA)


def times(df):
    return sorted(r["hours"] for r in df.collect())


def test_smoothing(spark):
    o = obs(spark, [(0.2, "1"), (0.9, "2"), (1.1, "3")])
    assert times(grids.smooth_hourly(o)) == [0.9, 1.1]
    assert times(grids.smooth_hourly(o, "first")) == [0.2, 1.1]


def test_negative_hours_share_slot_zero(spark):
    assert times(grids.smooth_hourly(obs(spark, [(-0.5, "1"), (0.5, "2")]))) == [0.5]


def test_slot_edges(spark):
    df = spark.createDataFrame([(47.9,), (48.0,), (48.9,), (49.5,)], "h double")
    stop = [r[0] for r in df.select(grids.hour_slot(F.col("h"), F.lit(48), "stop")).collect()]
    assert stop == [47, 47, 47, None]
    with pytest.raises(Exception, match="beyond the period"):
        df.select(grids.hour_slot(F.col("h"), F.lit(48))).collect()


def test_clip_stops_at_first_late_row(spark):
    o = obs(spark, [(1, "a"), (5, "b"), (2, "c")])
    labels = spark.createDataFrame([("s", 3.0)], "stay_id string, t double")
    assert times(grids.clip_to_bound(o, labels)) == [1.0]


def test_last_value_wins(spark):
    g = grids.grid_last(obs(spark, [(3.1, "5"), (3.2, None), (3.3, "7")]), 48).collect()
    assert [(r["slot"], r["value"]) for r in g] == [(3, 7.0)]


def test_grid_rejects_rows_beyond_the_period(spark):
    with pytest.raises(Exception, match="beyond the period"):
        grids.grid_last(obs(spark, [(60, "1")]), 48).collect()


def test_mean_and_compatible_mean(spark):
    o = obs(spark, [(3.1, None), (3.5, "4")])
    assert [r["value"] for r in grids.grid_mean(o, F.lit(48)).collect()] == [4.0]
    assert [r["value"] for r in grids.grid_mean(o, F.lit(48), {"c": 10.0}).collect()] == [14.0]
    # The first row of a slot counts after the edge rule: hour 48 joins slot 47, whose first row is not empty.
    edge = obs(spark, [(47.5, "2"), (48.0, None), (48.2, "4")])
    assert [r["value"] for r in grids.grid_mean(edge, F.lit(48), {"c": 10.0}).collect()] == [3.0]


def test_window_slots(spark):
    df = spark.createDataFrame([(5.0,), (5.5,), (100.0,)], "t double")
    assert [r[0] for r in df.select(grids.window_slots(F.col("t"), 48)).collect()] == [5, 6, 48]


def test_imputation_and_zscore(spark):
    stays = spark.createDataFrame([("s",)], "stay_id string")
    dense = grids.dense_grid(grids.grid_last(obs(spark, [(1, "1"), (2, "3")]), 4), stays, ["c"], F.lit(4))
    filled = [r["value"] for r in grids.impute_grid(dense, {"c": 9.0}).orderBy("slot").collect()]
    assert filled == [9.0, 1.0, 3.0, 3.0]
    z = [(r["value"], r["mask"]) for r in grids.zscore_grid(dense, ["c"]).orderBy("slot").collect()]
    assert z == [(0.0, 0), (-1.0, 1), (1.0, 1), (0.0, 0)]


def test_dropped_cells_lose_value_and_mask(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]] * 50, [[1, 0]] * 50)], "id int, x array<array<double>>, mask array<array<int>>")
    r = grids.drop_cells(df, "id", 0.5, 1).first()
    hidden = [i for i in range(50) if r["mask"][i][0] == 0]
    assert 10 < len(hidden) < 40
    assert all(r["x"][i][0] == 0.0 for i in hidden) and all(r["x"][i][1] == 2.0 for i in range(50))


def test_masking_partitions_the_mask(spark):
    df = spark.createDataFrame([(i, [[1.0] * 5] * 40, [[1] * 5] * 40) for i in range(20)], "id int, x array<array<double>>, mask array<array<int>>")
    for r in grids.mask_cells(df, "id", 0.2, 0.4, 7).collect():
        hidden = sum(map(sum, r["hidden_mask"]))
        assert hidden + sum(map(sum, r["kept_mask"])) == 200 and 10 <= hidden <= 110
        assert sum(map(sum, r["x"])) == 200 - hidden


def test_episode_samples(spark):
    rows = []
    for stay in range(4):
        for h in range(4 + stay):
            rows += [(f"p{stay}", h, h + 0.5, "Heart Rate", str(60.0 + 10 * stay + h)),
                     (f"p{stay}", h, h + 0.5, "Glascow coma scale eye opening", "4 Spontaneously" if h % 2 else None)]
    rows.append(("late", 0, 99.0, "Heart Rate", "1"))
    o = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(f"p{s}", s % 2) for s in range(4)] + [("late", 1)], "stay_id string, y int")
    out = {r["stay_id"]: r for r in prepare.episode_samples(o, labels, "mortality", 6).collect()}
    assert sorted(out) == ["p0", "p1", "p2", "p3"]
    heart = catalogue.CHANNELS.index("Heart Rate")
    assert all(r["lens"] == 6 and len(r["x"]) == 6 and len(r["x"][0]) == 17 for r in out.values())
    assert [m[heart] for m in out["p0"]["mask"]] == [1, 1, 1, 1, 0, 0]
    seen = [r["x"][i][heart] for r in out.values() for i in range(6) if r["mask"][i][heart]]
    assert sum(seen) == pytest.approx(0, abs=1e-9) and sum(v * v for v in seen) == pytest.approx(len(seen))
    los = labels.withColumn("t", F.lit(3.0)).withColumn("y", F.lit(80.0))
    got = prepare.episode_samples(o, los, "los", 48).collect()
    assert {r["lens"] for r in got} == {3} and {r["label"] for r in got} == {1}


def test_each_label_row_is_a_sample(spark):
    o = spark.createDataFrame([("s1", h, h + 0.5, "Heart Rate", str(60.0 + h)) for h in range(10)], SCHEMA)
    los = spark.createDataFrame([("s1", 3.0, 80.0), ("s1", 8.0, 10.0), ("s2", 4.0, 10.0)], "stay_id string, t double, y double")
    got = {r["lens"]: r for r in prepare.episode_samples(o, los, "los", 48).collect()}
    assert sorted(got) == [3, 8] and {r["stay_id"] for r in got.values()} == {"s1"} and len({r["sample_id"] for r in got.values()}) == 2
    heart = catalogue.CHANNELS.index("Heart Rate")
    for n, r in got.items():
        assert [m[heart] for m in r["mask"]] == [1] * n
        assert all(b > a for a, b in zip([x[heart] for x in r["x"]], [x[heart] for x in r["x"]][1:]))
    assert (got[3]["label"], got[8]["label"]) == (1, 0)


def test_unknown_label_in_episode_fails(spark):
    o = spark.createDataFrame([("p", 0, 0.5, "Glascow coma scale total", "99")], SCHEMA)
    with pytest.raises(Exception, match="unknown category label"):
        prepare.coded(o).collect()
