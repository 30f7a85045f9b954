import json

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.grids import drop_empty, skipped_stays
from cohortflow.operators.scoring import score_batches
from cohortflow.plans import prepare
from cohortflow.session import drop_written, work_folder, written, written_with
from cohortflow.sources import episodes, tables


def test_episode_files(spark, tmp_path):
    for stay, rows in {"a.csv": ["0.1,5,", "0.2,,x", "1.0,7,y"], "b.csv": ["3,1,z"]}.items():
        (tmp_path / stay).write_text("\n".join(["Hours,Heart Rate,pH", *rows]) + "\n")
    got = episodes.read_episodes(spark, str(tmp_path)).orderBy("stay_id", "row_no", "channel").collect()
    assert [(r["stay_id"], r["hours"], r["channel"], r["raw"]) for r in got][:4] == [
        ("a.csv", 0.1, "Heart Rate", "5"), ("a.csv", 0.1, "pH", None), ("a.csv", 0.2, "Heart Rate", None), ("a.csv", 0.2, "pH", "x")]
    assert len(got) == 8


def test_row_order_survives_file_splits(spark, tmp_path):
    lines = [f"{(i * 7919) % 4000 / 10},{i}" for i in range(4000)]
    (tmp_path / "s.csv").write_text("\n".join(["Hours,c", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = episodes.read_episodes(spark, str(tmp_path))
        rows = written(df).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(r["raw"]) for r in rows] == list(range(4000)) and len({r["row_no"] for r in rows}) == 4000


def test_first_column_must_be_hours(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,c\n1,2\n")
    with pytest.raises(ValueError, match="Hours"):
        episodes.read_episodes(spark, str(tmp_path))


def test_listfiles(spark, tmp_path):
    def read(task, header, line):
        path = tmp_path / f"{task}.csv"
        path.write_text(f"{header}\n{line}\n")
        return episodes.read_listfile(spark, str(path), task).first()

    assert tuple(read("mortality", "stay,y", "s,1")) == ("s", 1)
    assert tuple(read("decompensation", "stay,t,y", "s,5.0,0")) == ("s", 5.0, 0)
    assert tuple(read("los", "stay,t,y", "s,5.0,71.5")) == ("s", 5.0, 71.5)
    assert read("phenotyping", "stay,t," + ",".join(map(str, range(25))), "s,5.0," + ",".join("01"[i % 2] for i in range(25)))["y"] == [0, 1] * 12 + [0]
    m = read("multitask", "stay,t,ihm,los,pheno,decomp", "s,5.0,1;2;0,1;0;3.5;4.5,0;1,")
    assert m["ihm"] == [1, 2, 0] and tuple(m["los"]) == ([1, 0], [3.5, 4.5]) and m["pheno"] == [0, 1]
    assert tuple(m["decomp"]) == ([], [])


def test_pool_and_empty_stays(spark):
    a = spark.createDataFrame([("x", 1)], "stay_id string, y int")
    both = episodes.pool(a, spark.createDataFrame([(2, "z")], "y int, stay_id string"))
    obs = spark.createDataFrame([("x", 1), ("x", 2)], "stay_id string, row_no int")
    assert [r["stay_id"] for r in drop_empty(both, obs).collect()] == ["x"]
    assert tuple(skipped_stays(both, obs).first()) == (1, 1)


def test_visit_records(spark, tmp_path):
    rows = [("p", [["1", "2"], ["3", "4"]], [[0.5, None], [1.0, 2.0]], [0.0, 1.0, 2.0], None, [1, 0], 1),
            ("q", [["1"], ["2", "3"]], [[0.0, 0.0]], None, None, [0], 0)]
    schema = ("id string, x_llm_ts array<array<string>>, x_ts array<array<double>>, record_time array<double>, "
              "missing_mask array<array<int>>, y_mortality array<int>, y_los int")
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "v"))
    got = episodes.read_visits(spark, str(tmp_path / "v"), "mortality", 2).collect()
    assert [(r["name"], r["t"], r["y"]) for r in got] == [("p", 2, 1)]
    assert episodes.read_visits(spark, str(tmp_path / "v"), "los", None).count() == 2
    s = prepare.visit_samples(episodes.read_visits(spark, str(tmp_path / "v"), "mortality", 2), 2).first()
    assert s["mask"] == [[1, 0], [1, 1]] and s["lens"] == 2
    with pytest.raises(Exception, match="row p"):
        prepare.visit_samples(episodes.read_visits(spark, str(tmp_path / "v"), "mortality", 2), 3).select("x").collect()


def test_headers(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,), (["a"],)], "n array<string>")
    got = [r[0] for r in df.select(episodes.channel_header(F.col("n"), 2)).collect()]
    assert got[0] == ["Sex", "Age", "a", "b"] and got[1] == got[2] == ["Sex", "Age", "labtest_features[0]", "labtest_features[1]"]


def test_questions(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    rows = [{"question": "q1", "option": {"A": "x"}, "answer": "A"}, {"question": "q2", "extra": 1}]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    got = episodes.read_questions(spark, str(path)).collect()
    assert got[0]["option"] == {"A": "x"} and got[1]["answer"] is None and "extra" not in got[0].asDict()


def test_channel_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({
        "id_to_channel": ["pH", "GCS"], "is_categorical_channel": {"pH": False, "GCS": True},
        "possible_values": {"pH": [], "GCS": ["x"]}, "normal_values": {"pH": "7.4", "GCS": "x"}}, indent=1))
    (tmp_path / "m.json").write_text(json.dumps({"pH": {"possible_values": []}, "GCS": {"possible_values": ["x"], "values": {"x": 4}}}, indent=1))
    channels, codes = episodes.read_channels(spark, str(tmp_path / "c.json"), str(tmp_path / "m.json"))
    assert [tuple(r) for r in channels.orderBy("idx").collect()] == [(0, "pH", False, "7.4"), (1, "GCS", True, "x")]
    assert [tuple(r) for r in codes.collect()] == [("GCS", "x", 4.0)]


def test_prepared_tables(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    tables.write_prepared(df, str(tmp_path), "icu", 1, 48)
    assert tables.read_prepared(spark, str(tmp_path), "icu", 1, 48).filter("split = 'test'").count() == 2


def test_fingerprint_follows_content_only(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a" if i % 2 else "b") for i in range(50)], "id int, text string, split string")
    first = tables.cache_key(tables.fingerprint(df, "id", "text", "split"), {"model": "m"})
    assert first == tables.cache_key(tables.fingerprint(df.repartition(7), "id", "text", "split"), {"model": "m"})
    other = df.withColumn("text", F.when(F.col("id") == 3, "x").otherwise(F.col("text")))
    assert first != tables.cache_key(tables.fingerprint(other, "id", "text", "split"), {"model": "m"})
    assert first != tables.cache_key(tables.fingerprint(df, "id", "text", "split"), {"model": "n"})


def test_stored_tables_are_reused(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3).withColumn("vec", F.array(F.lit(1.0)))

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path), "k", ["id", "vec"], compute).count() == 3
    assert len(calls) == 1
    with pytest.raises(KeyError, match="lacks columns"):
        tables.cached(spark, str(tmp_path), "k", ["other"], compute)


def test_metric_file(spark, tmp_path):
    tables.write_metrics(spark.createDataFrame([("auroc", 0.5)], "metric string, value double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["value"] == 0.5


def test_written_tables(spark):
    table, seen = written_with(spark.range(9), "t", n=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"n": 9, "top": 8} and table.count() == 9
    assert all(f.startswith(("file:" + work_folder(spark), work_folder(spark))) or work_folder(spark) in f for f in table.inputFiles())


def test_batch_scorer_sets_up_once_per_partition(spark):
    def make():
        state = {"n": 0}

        def score(pdf):
            state["n"] += 1
            return pdf.assign(batch=state["n"])
        return score

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = score_batches(spark.range(0, 60, 1, 2), make, "id bigint, batch bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["batch"] for r in rows} == {1, 2, 3}


def test_written_tables_can_be_dropped(spark):
    table = written(spark.range(5), "gone")
    assert table.count() == 5
    drop_written(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table.inputFiles()[0]).count()
    assert written(spark.range(2), "again").count() == 2
