"""Reading answers out of free text and option scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import array_sum, let, softmax

# The answer formats that are recognised.
THINKING = r"(?s)<think>.*?</think>"
NUMBER = r"-?\d+\.?\d*"
KEYWORDS_FOUR_CLASS = "答案|选项|选择|answer|option|choice|category"
KEYWORDS_EXAM = "答案|选项|选择|answer|option|choice"
OPENING, CLOSING = r"[\(\[（【]", r"[\)\]）】]"


def parse_probability(response: Column) -> Column:
    """Last number within [0, 1] outside thinking tags; else the first number; else -1."""
    numbers = F.transform(
        F.regexp_extract_all(F.regexp_replace(response, THINKING, ""), F.lit(NUMBER), F.lit(0)),
        lambda t: t.try_cast("double"),
    )
    return let(numbers, lambda v: F.coalesce(
        F.try_element_at(F.filter(v, lambda x: x.between(0.0, 1.0)), F.lit(-1)), F.try_element_at(v, F.lit(1)), F.lit(-1.0)))


def _letter(text: Column, letters: str, keywords: str) -> Column:
    def tries(t):
        steps = [
            (t, f"^([{letters}])"),
            (t, f"{OPENING}([{letters}]){CLOSING}"),
            (t, f"(?iU)(?:{keywords})[:：\\s]*([{letters}])"),
            (F.substring(t, 1, 50), f"(?U)\\b([{letters}])\\b"),
        ]
        return F.coalesce(*[F.nullif(F.upper(F.regexp_extract(c, p, 1)), F.lit("")) for c, p in steps])

    return let(F.upper(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), tries)


def parse_letter_ad(response: Column) -> Column:
    """Letter A-D: leading letter, bracketed, after a keyword, or alone in the first 50 characters.

    A leading letter wins, so ``ANSWER: B`` reads as A; results must agree with that.
    """
    return _letter(response, "A-D", KEYWORDS_FOUR_CLASS)


def parse_letter_az(response: Column) -> Column:
    """Letter A-Z by the same steps, after dropping thinking tags."""
    return _letter(F.regexp_replace(response, THINKING, ""), "A-Z", KEYWORDS_EXAM)


def strip_prompt(text: Column, prompt: Column) -> Column:
    """Text after the last occurrence of the prompt, trimmed; the whole text when the prompt is absent."""
    # The prompt is data, not a pattern, so its last place is found on the reversed strings.
    back = F.call_function("locate", F.reverse(prompt), F.reverse(text))
    tail = F.when((back > 0) & (F.length(prompt) > 0),
                  F.substring(text, F.length(text) - back + 2, F.length(text))).otherwise(text)
    return F.regexp_replace(tail, r"(?U)^\s+|\s+$", "")


def option_probs(logprobs: Column, options) -> Column:
    """Option log-probabilities as probabilities; a missing or infinite one counts as -1e10."""
    values = F.array(*[F.try_element_at(logprobs, F.lit(o)) for o in options])
    clean = F.transform(values, lambda v: F.when(
        v.isNull() | (F.abs(v) == float("inf")), F.lit(-1e10)).otherwise(v.cast("double")))
    return softmax(clean)


def option_vector(scores: Column, options) -> Column:
    """Option scores rescaled to sum to one; missing counts as 0, nothing usable gives the uniform vector."""
    k = len(options)
    values = F.array(*[F.coalesce(F.try_element_at(scores, F.lit(o)).cast("double"), F.lit(0.0)) for o in options])
    uniform = F.array_repeat(F.lit(1.0 / k), k)
    shares = let(values, lambda w: let(array_sum(w), lambda total: F.when(total > 0, F.transform(
        w, lambda v: v / total)).otherwise(uniform)))
    return F.when(scores.isNull(), uniform).otherwise(shares)
