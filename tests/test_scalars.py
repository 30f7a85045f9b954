import math

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import arrays, scalars


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [("4 Spontaneously", 4.0), (" -1.5x", -1.5), ("None", None), ("12.", 12.0), ("", None)])
def test_leading_number(spark, text, want):
    assert one(spark, text, "string", scalars.leading_number) == want


@pytest.mark.parametrize("hours,want", [(71.9, 0), (72.0, 1), (168.0, 2), (336.0, 3)])
def test_bucketize_los(spark, hours, want):
    assert one(spark, hours, "double", scalars.bucketize_los) == want


def test_one_hot(spark):
    assert one(spark, 2, "int", lambda c: scalars.one_hot(c, 4)) == [0, 0, 1, 0]


@pytest.mark.parametrize("cell", ["", "nan", "NaN", " None ", None])
def test_missing(spark, cell):
    assert one(spark, cell, "string", scalars.null_if_missing) is None


@pytest.mark.parametrize("v", [0.0, -0.0, 1.0, -1.5, 12345678.0, 1e15, 1e16, 1.5e16, -2.5e20, 0.001, 0.00012, -0.0001, 1e-5,
                               1.25e-7, 1e300, 123456789.125, 1e7, math.inf, -math.inf, 2.0**53])
def test_number_text_as_python(spark, v):
    assert one(spark, v, "double", scalars.py_number) == str(v)


def test_unknown_category_fails(spark):
    with pytest.raises(Exception, match="unknown category label"):
        one(spark, "huh", "string", lambda c: scalars.encode_category(c, {"a": 1}))
    assert one(spark, None, "string", lambda c: scalars.encode_category(c, {"a": 1})) is None


def test_decode_category(spark):
    eye = F.lit("Glascow coma scale eye opening")
    assert one(spark, 3.0, "double", lambda c: scalars.decode_category(eye, c)) == "To Speech"
    assert one(spark, 9.0, "double", lambda c: scalars.decode_category(eye, c)) == "9.0"


def test_label_letters(spark):
    assert [one(spark, v, "string", scalars.label_letter) for v in ("0", "3", "4", "x")] == ["A", "D", "4", "x"]


def test_softmax_and_letters(spark):
    p = one(spark, [1000.0, 1000.0 + math.log(3)], "array<double>", scalars.softmax)
    assert p == pytest.approx([0.25, 0.75])
    assert one(spark, [0.0, 2.0, 2.0, 1.0], "array<double>", scalars.argmax_letter) == "B"


def test_attention_map(spark):
    m = one(spark, [0.1, 0.2, 0.7], "array<double>", lambda c: scalars.attention_map(
        F.array(F.lit("a"), F.lit("b"), F.lit("unused")), c))
    assert m == {"a": 0.1, "b": 0.2, "demo": 0.7}
    assert one(spark, [0.1, 0.2, 0.7], "array<double>", lambda c: scalars.attention_map(F.array(F.lit("a")), c)) == {"a": 0.1, "demo": 0.7}


def test_width_check_names_the_row(spark):
    df = spark.createDataFrame([("p7", [[1.0, 2.0], [3.0]])], "id string, x array<array<double>>")
    with pytest.raises(Exception, match="row p7"):
        df.select(arrays.checked_width(F.col("x"), 2, F.col("id"))).collect()


def test_presence_and_masks(spark):
    m = one(spark, [[1.0, None], [float("nan"), 2.0]], "array<array<double>>", arrays.presence_mask)
    assert m == [[1, 0], [0, 1]]
    assert one(spark, [[0, 1], [0, 0]], "array<array<int>>", lambda c: arrays.time_mask(c, "max")) == [1, 0]
    assert one(spark, [5, 6, 7], "array<int>", lambda c: arrays.last_step(c, F.lit(2))) == 6
    assert one(spark, [5, 6, 7], "array<int>", lambda c: arrays.last_step(c, F.lit(0))) == 5
