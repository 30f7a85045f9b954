import math

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import answers


def read(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [("<think>0.9</think> p 1.5 then 0.7", 0.7), ("5 of 7", 5.0), ("none", -1.0),
                                       ("<think>a\n0.2</think>", -1.0), ("0.3 or 0.4 or -2", 0.4), ("1.", 1.0)])
def test_probability(spark, text, want):
    assert read(spark, answers.parse_probability, text) == want


@pytest.mark.parametrize("text,want", [("ANSWER: B", "A"), ("(c)", "C"), ("xyz", None), ("", None), (None, None),
                                       ("我认为【b】", "B"), ("最终答案：C", "C"), ("选项 D", "D"), ("so it is d .", "D"),
                                       ("字A字", None), ("x" * 60 + " A", None), ("　b", "B")])
def test_letter_ad(spark, text, want):
    assert read(spark, answers.parse_letter_ad, text) == want


@pytest.mark.parametrize("text,want", [("(c)", "C"), ("<think>A</think> d", "D"), ("1: category: e", "E"), ("", None)])
def test_letter_az(spark, text, want):
    assert read(spark, answers.parse_letter_az, text) == want


def test_strip_prompt(spark):
    df = spark.createDataFrame([("a.b a.b  out \n", "a.b"), (" x ", "nope"), ("keep", "")], "t string, p string")
    got = [r["r"] for r in df.select(answers.strip_prompt(F.col("t"), F.col("p")).alias("r")).collect()]
    assert got == ["out", "x", "keep"]


def test_option_probs(spark):
    p = read(spark, lambda c: answers.option_probs(c, "ABCD"), {"A": math.log(0.5), "B": math.log(0.25)}, "map<string,double>")
    assert p == pytest.approx([2 / 3, 1 / 3, 0, 0])
    p = read(spark, lambda c: answers.option_probs(c, "AB"), {"A": -math.inf, "B": 0.0}, "map<string,double>")
    assert p == pytest.approx([0, 1])


@pytest.mark.parametrize("scores,want", [({"A": 0.2}, [1, 0, 0, 0]), ({}, [0.25] * 4), (None, [0.25] * 4)])
def test_option_vector(spark, scores, want):
    assert read(spark, lambda c: answers.option_vector(c, "ABCD"), scores, "map<string,double>") == pytest.approx(want)
