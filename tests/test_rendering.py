from pyspark.sql import functions as F

from cohortflow.operators import entropy, rendering
from cohortflow.plans import catalogue

SCHEMA = "stay_id string, row_no int, hours double, channel string, raw string"
EYE, GLU = "Glascow coma scale eye opening", "Glucose"


def detail(spark, rows, **kw):
    df = spark.createDataFrame([("s", i, h, c, v) for i, (h, c, v) in enumerate(rows)], SCHEMA)
    df = df.withColumn("row_no", (F.col("hours") * 10).cast("int"))
    return rendering.render_detail(df, [EYE, GLU], **kw).first()


def test_detail(spark):
    r = detail(spark, [(0.1, EYE, "4 Spontaneously"), (0.1, GLU, "100"), (0.9, EYE, "2 To pain"), (0.9, GLU, "x"),
                       (1.5, EYE, "None"), (1.5, GLU, None), (2.5, EYE, "9"), (2.5, GLU, "128.50")])
    assert r["detail"] == f"- {EYE}: [To Pain, NaN, 9.0]\n- {GLU}: [nan, NaN, 128.5]"
    assert r["times"] == [0.9, 1.5, 2.5]


def test_detail_notes(spark):
    rows = [(0.1, GLU, "7")]
    assert f"- {GLU} (Unit: mg/dL.): [7.0]" in detail(spark, rows, units=catalogue.UNITS)["detail"]
    both = detail(spark, rows, units=catalogue.UNITS, ranges=catalogue.RANGES, smooth=False)["detail"]
    assert both.endswith(f"- {GLU} (Unit: mg/dL. Reference range: 70 - 100.): [7.0]")


def test_visits(spark):
    df = spark.createDataFrame([([["1", "nan"], ["", "None"]], ["Sex", "Age"])], "x array<array<string>>, h array<string>")
    out = df.select(rendering.render_visits(F.col("x"), F.col("h")).alias("a"),
                    rendering.render_visits(F.col("x"), F.col("h"), True).alias("b")).first()
    assert out["a"] == "- Sex: [1, NaN]\n- Age: [nan, None]" and out["b"] == "- Sex: [1, NaN]\n- Age: [NaN, NaN]"


def test_prompts(spark):
    q = spark.createDataFrame([(1, "D{EXAMPLE}", [0.5, 1.0], [0.0, 0.0])], "query_id int, detail string, times array<double>, logits array<double>")
    ex = spark.createDataFrame([(1, 2, "two", 0, [1.0, 1.0]), (1, 1, "one", 1, [0.0, 0.0])],
                               "query_id int, rank int, detail string, label int, logits array<double>")
    zero = rendering.render_prompt(q, "icu_mortality").first()["prompt"]
    assert "- Count: 2\n" in zero and "[0.50, 1.00]" in zero and zero.endswith("Clinical Features Over Time:\nD{EXAMPLE}")
    few = rendering.render_prompt(q, "icu_mortality", ex, for_entropy=True).first()["prompt"]
    assert "Example 1:\none\nLabel: 1\n\nExample 2:\ntwo\nLabel: 0" in few and few.endswith("D{EXAMPLE}\nLabel:")
    hint = rendering.render_prompt(q, "icu_mortality", ex, expert="risk", query_expert="risk").first()["prompt"]
    assert "one\nExpert Model Outputs:  0.5000\nLabel: 1" in hint and hint.endswith("\nExpert Model Outputs:  0.5000")
    letter = rendering.render_prompt(q, "icu_los", ex, "letter", "letter", "letter").first()["prompt"]
    assert "one\nExpert Model Outputs: A\nLabel: B" in letter and letter.endswith("in the manner of the examples above:")


def test_questions(spark):
    df = spark.createDataFrame([("单选题", "Q?", {"A": "x", "B": "y"})], "t string, q string, o map<string,string>")
    text = df.select(rendering.render_question(F.col("t"), F.col("q"), F.col("o")).alias("d")).first()["d"]
    assert text == "题型：单选题\n题目：Q?\n\n可选答案：\nA. x\nB. y\n\n"
    q = spark.createDataFrame([(1, text)], "query_id int, detail string")
    ex = spark.createDataFrame([(1, 1, "old", "C")], "query_id int, rank int, detail string, label string")
    assert "例子 1:\nold\n答案: C" in rendering.render_question_prompt(q, ex).first()["prompt"]
    assert text in rendering.render_question_prompt(q).first()["prompt"]


def test_training_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3], [8, 9])], "p array<int>, t array<int>")
    for size, ids, labels in ((10, [1, 2, 3, 8, 9], [-100] * 3 + [8, 9]), (4, [1, 2, 3, 8], [-100] * 3 + [8]), (2, [1, 2], [-100] * 2)):
        r = df.select(rendering.sft_pairs(F.col("p"), F.col("t"), size).alias("s")).first()["s"]
        assert (r["input_ids"], r["labels"], r["attention_mask"]) == (ids, labels, [1] * len(ids))
    assert spark.range(1).select(rendering.sft_target(F.lit(1.0))).first()[0] == "1.0"


def test_chat(spark):
    m = spark.range(1).select(rendering.chat_messages(F.lit("hi")).alias("m"), rendering.chat_messages(F.lit("hi"), None).alias("u")).first()
    assert [tuple(x) for x in m["m"]] == [("system", "You are a helpful assistant."), ("user", "hi")] and len(m["u"]) == 1


def test_scored_span(spark):
    rows = [("a b\nClinical Features Over Time:\nx y\nLabel:", "x y"), ("in x y Label: q Label:", "x y"), ("p Label: r Label: s", "none")]
    df = spark.createDataFrame(rows, "p string, d string")
    got = [tuple(r["s"]) for r in df.select(entropy.scored_span(F.col("p"), F.col("d")).alias("s")).collect()]
    assert got == [(6, 9), (1, 6), (3, 4)]


def test_task_table(spark):
    rows = {r["task"]: r for r in catalogue.task_catalog(spark).collect()}
    assert rows["icu_los"]["n_classes"] == 4 and rows["ward_mortality"]["n_features"] == 75
    assert len(catalogue.CHANNELS) == 17 and catalogue.normal_codes()["Glascow coma scale motor response"] == 6.0
