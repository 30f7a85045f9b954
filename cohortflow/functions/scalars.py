"""Scalar clean-up, category codes, labels, probabilities and number text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Class letters of the length-of-stay task and clinical names of the coma-scale codes.
LETTERS = ("A", "B", "C", "D")
LOS_DAY_EDGES = (3.0, 7.0, 14.0)
COMA_LABELS = {
    "Glascow coma scale eye opening": {
        1: "No Response", 2: "To Pain", 3: "To Speech", 4: "Spontaneously",
    },
    "Glascow coma scale motor response": {
        1: "No Response", 2: "Abnormal Extension", 3: "Abnormal Flexion", 4: "Flex-withdraws",
        5: "Localizes Pain", 6: "Obeys Commands",
    },
    "Glascow coma scale verbal response": {
        1: "No Response", 2: "Incomprehensible sounds", 3: "Inappropriate Words", 4: "Confused",
        5: "Oriented",
    },
}
TASK_POSITION = {"mortality": 0, "los": 1, "readmission": 2}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def leading_number(c: Column) -> Column:
    """The number a messy value starts with, else null."""
    text = F.nullif(F.regexp_extract(c.cast("string"), r"^\s*(-?\d+\.?\d*)", 1), F.lit(""))
    return text.try_cast("double")


def null_if_missing(c: Column) -> Column:
    """Empty text, ``nan`` in any case and ``None`` become null."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none"), c)


def encode_category(label: Column, codes: dict[str, float]) -> Column:
    """Ordinal code of a category label; an unknown label is an error, null stays null."""
    code = F.try_element_at(literal_map({k: float(v) for k, v in codes.items()}), label)
    return F.when(label.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(code, F.raise_error(F.concat(F.lit("unknown category label: "), label)).cast("double"))
    )


def decode_category(channel: Column, code: Column) -> Column:
    """Clinical label of a coma-scale code; other channels and unknown codes keep the number text."""
    names = literal_map({f"{ch}|{k}": v for ch, labels in COMA_LABELS.items() for k, v in labels.items()})
    key = F.concat(channel, F.lit("|"), code.cast("int").cast("string"))
    return F.coalesce(F.try_element_at(names, key), py_number(code))


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body mentions it."""
    return F.transform(F.array(c), body)[0]


def py_number(c: Column) -> Column:
    """Number text as Python prints it: plain digits for |x| in [1e-4, 1e16), two-digit exponents outside.

    The shortest digits come from the plain double-to-text cast; only its exponent form is laid out anew.
    """
    def plain(t):
        special = F.try_element_at(literal_map({"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}), t)
        return F.when(F.contains(t, F.lit("E")), let(F.split(t, "E"), _plain_digits)).otherwise(F.coalesce(special, t))

    return let(c.cast("double").cast("string"), plain)


def _plain_digits(parts: Column) -> Column:
    """``["-1.25", "7"]`` as ``-12500000.0``."""
    def layout(s):
        sign, digits, exp = s["sign"], s["digits"], s["exp"]
        whole = F.rpad(digits, F.greatest(exp + 1, F.length(digits)), "0")
        tail = F.substring(whole, exp + 2, F.length(whole))
        large = F.concat(sign, F.substring(whole, F.lit(1), exp + 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        rest = F.substring(digits, F.lit(2), F.length(digits))
        power = F.abs(exp).cast("string")
        sci = F.concat(sign, F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)),
                       F.when(exp < 0, "e-").otherwise("e+"), F.when(F.length(power) < 2, F.lit("0")).otherwise(""), power)
        return F.when(exp.between(0, 15), large).when(exp.between(-4, -1), small).otherwise(sci)

    mantissa = parts[0]
    digits = F.regexp_replace(F.regexp_replace(mantissa, "[-.]", ""), "(?<=.)0+$", "")
    return let(F.struct(F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise("").alias("sign"), digits.alias("digits"),
                        parts[1].cast("int").alias("exp")), layout)


def bucketize_los(hours: Column, edges_days=LOS_DAY_EDGES) -> Column:
    """Class of a stay in hours: number of day edges at or below hours/24."""
    days = hours / F.lit(24.0)
    return reduce(lambda a, b: a + b, [(days >= F.lit(float(e))).cast("int") for e in edges_days])


def one_hot(index: Column, n: int) -> Column:
    """0/1 vector with a one at ``index``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))


def label_letter(label: Column) -> Column:
    """0..3 become A..D; any other value keeps its text."""
    index = label.try_cast("double").cast("int")
    name = F.try_element_at(F.array(*[F.lit(v) for v in LETTERS]), index + 1)
    return F.coalesce(F.when(index.between(0, len(LETTERS) - 1), name), label.cast("string"))


def letter_label(letter: Column) -> Column:
    """Inverse of :func:`label_letter`."""
    return F.try_element_at(literal_map({v: i for i, v in enumerate(LETTERS)}), letter)


def time_list(times: Column) -> Column:
    """Array of hours as ``0.50, 1.00``."""
    return F.array_join(F.transform(times, lambda v: F.format_string("%.2f", v.cast("double"))), ", ")


def task_label(labels: Column, task: str) -> Column:
    """The task's entry of a (mortality, length of stay, readmission) label vector."""
    return F.try_element_at(labels, F.lit(TASK_POSITION[task] + 1))


def reverse_los(y: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """Undo a standardisation."""
    return y * F.lit(float(std)) + F.lit(float(mean))


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))


def softmax(logits: Column) -> Column:
    """Softmax shifted by the maximum."""
    weights = let(F.array_max(logits).cast("double"), lambda top: F.transform(
        logits, lambda v: F.exp(v.cast("double") - top)))
    return let(weights, lambda w: let(array_sum(w), lambda total: F.transform(w, lambda x: x / total)))


def risk(logits: Column) -> Column:
    """Probability of the positive class of a two-class logit vector."""
    return F.element_at(softmax(logits), 2)


def argmax_index(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_letter(logits: Column) -> Column:
    """Letter of the most likely class."""
    return label_letter(argmax_index(logits))


def attention_map(names: Column, scores: Column) -> Column:
    """Name -> score; the last score belongs to the demographics and is keyed ``demo``.

    Names beyond the feature scores, and scores beyond the names, are left out.
    """
    n = F.least(F.size(names), F.size(scores) - 1)
    return F.map_from_arrays(F.concat(F.slice(names, F.lit(1), n), F.array(F.lit("demo"))),
                             F.concat(F.slice(scores, F.lit(1), n), F.slice(scores, -1, 1)))
