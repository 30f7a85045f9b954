"""Patient records, prompts, questions and training pairs as text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import (COMA_LABELS, argmax_letter, label_letter, leading_number, let, literal_map,
                                 null_if_missing, py_number, risk, time_list)
from ..plans import catalogue
from .grids import smooth_hourly


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{NAME}`` places filled; values are never searched for places themselves."""
    parts = re.split(r"\{([A-Z_]+)\}", template)
    cols = [F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*cols)


def _cell(channel: str, raw: Column) -> Column:
    if channel in COMA_LABELS:
        names = literal_map(COMA_LABELS[channel])
        text = let(leading_number(raw), lambda number: F.coalesce(
            F.try_element_at(names, number.cast("int")), py_number(number), F.lit("NaN")))
    else:
        text = F.coalesce(py_number(leading_number(raw)), F.lit("nan"))
    return F.when(raw.isNull() | (raw == ""), "NaN").otherwise(text)


def detail_line(channel: str, values: Column, units: dict | None, ranges: dict | None) -> Column:
    note = " ".join(d[channel] for d in (units, ranges) if d)
    head = f"- {channel} ({note.rstrip()}): [" if units or ranges else f"- {channel}: ["
    return F.concat(F.lit(head), F.array_join(values, ", "), F.lit("]"))


def render_detail(obs: DataFrame, channels: list[str], units: dict | None = None, ranges: dict | None = None,
                  smooth: bool = True, keep: str = "last", bucket: float = 1.0) -> DataFrame:
    """One text per stay, one line per channel: ``(stay_id, detail, times)``.

    Missing cells print ``NaN``, unreadable continuous values ``nan``, coma-scale codes their clinical label.
    """
    rows = smooth_hourly(obs, keep, bucket) if smooth else obs
    cells = [F.max(F.when(F.col("channel") == c, F.col("raw").cast("string"))) for c in channels]
    wide = rows.groupBy("stay_id", "row_no").agg(F.min("hours").alias("hours"), F.array(*cells).alias("cells"))
    stays = wide.groupBy("stay_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "hours", "cells"))).alias("r"))

    def values(i, channel):
        return F.transform("r", lambda x: _cell(channel, x["cells"][i]))

    lines = [detail_line(c, values(i, c), units, ranges) for i, c in enumerate(channels)]
    return stays.select("stay_id", F.concat_ws("\n", *lines).alias("detail"),
                        F.transform("r", lambda x: x["hours"]).alias("times"))


def render_visits(x: Column, header: Column, any_missing: bool = False) -> Column:
    """Visit matrix as text, one line per feature, values as they are; missing prints ``NaN``.

    ``any_missing`` also reads ``nan`` and ``None`` as missing, not just the empty text.
    """
    def show(v):
        blank = null_if_missing(v).isNull() if any_missing else (v.isNull() | (v == ""))
        return F.when(blank, "NaN").otherwise(v.cast("string"))

    lines = F.transform(header, lambda name, i: F.concat(F.lit("- "), name, F.lit(": ["), F.array_join(
        F.transform(x, lambda row: show(F.element_at(row, i + 1))), ", "), F.lit("]")))
    return F.array_join(lines, "\n")


# How an expert's output is written; the risk form has two blanks.
EXPERT_RISK = "Expert Model Outputs:  "
EXPERT_LETTER = "Expert Model Outputs: "
FOCUS = "\nGive the expert model's output the most weight, and answer in the manner of the examples above:"


def expert_text(logits: Column, kind: str) -> Column:
    """``risk``: probability with four decimals; ``letter``: most likely class."""
    if kind == "risk":
        return F.concat(F.lit(EXPERT_RISK), F.format_string("%.4f", risk(logits)))
    return F.concat(F.lit(EXPERT_LETTER), argmax_letter(logits))


def example_texts(exemplars: DataFrame, label_kind: str = "plain", expert: str | None = None, word: str = "Example",
                  answer: str = "Label") -> DataFrame:
    """Examples of a query in rank order, joined by blank lines: ``(query_id, example)``."""
    label = label_letter(F.col("label")) if label_kind == "letter" else F.col("label").cast("string")
    hint = [F.lit("\n"), expert_text(F.col("logits"), expert)] if expert else []
    text = F.concat(F.lit(f"{word} "), F.col("rank").cast("string"), F.lit(":\n"), F.col("detail"), *hint,
                    F.lit(f"\n{answer}: "), label)
    ordered = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return exemplars.groupBy("query_id").agg(ordered.alias("e")).select(
        "query_id", F.array_join(F.transform("e", lambda s: s["text"]), "\n\n").alias("example"))


def render_prompt(queries: DataFrame, task: str, exemplars: DataFrame | None = None, label_kind: str = "plain",
                  expert: str | None = None, query_expert: str | None = None, for_entropy: bool = False) -> DataFrame:
    """Prompts ``(query_id, prompt)``: zero-shot without exemplars, few-shot with them.

    ``queries(query_id, detail, times[, logits])``, ``exemplars(query_id, rank, detail, label[, logits])``.
    ``expert`` adds the expert output to examples, ``query_expert`` to the query (letters also ask to focus on
    it), ``for_entropy`` ends the prompt with ``Label:``. Times decide the header: pass smoothed or raw ones.
    """
    row = catalogue.task_row(task)
    if exemplars is None:
        template, q = catalogue.ZERO_SHOT, queries.withColumn("example", F.lit(""))
    else:
        template = catalogue.FEW_SHOT_EXPERT if expert else catalogue.FEW_SHOT
        q = queries.join(example_texts(exemplars, label_kind, expert), "query_id", "left")
    prompt = fill(template, LENGTH=F.size("times"), RECORD_TIME_LIST=time_list(F.col("times")),
                  TASK_DESCRIPTION=F.lit(row["task_text"]), RESPONSE_FORMAT=F.lit(row["answer_format"]),
                  EXAMPLE=F.col("example"), DETAIL=F.col("detail"))
    if query_expert:
        prompt = F.concat(prompt, F.lit("\n"), expert_text(F.col("logits"), query_expert))
        if query_expert == "letter":
            prompt = F.concat(prompt, F.lit(FOCUS))
    if for_entropy:
        prompt = F.concat(prompt, F.lit("\nLabel:"))
    return q.select("query_id", prompt.alias("prompt"))


def render_question(question_type: Column, question: Column, option: Column) -> Column:
    """Exam question with one line per option."""
    lines = F.transform(F.map_entries(option), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    return fill(catalogue.QUESTION_DETAIL, TYPE=question_type, QUESTION=question, OPTIONS=F.array_join(lines, "\n"))


def render_question_prompt(queries: DataFrame, exemplars: DataFrame | None = None) -> DataFrame:
    """Question prompts ``(query_id, prompt)``; ``queries(query_id, detail)``, exemplars as for prompts."""
    row = catalogue.task_row("exam")
    if exemplars is None:
        template, q = catalogue.QUESTION_ZERO_SHOT, queries.withColumn("example", F.lit(""))
    else:
        template = catalogue.QUESTION_FEW_SHOT
        q = queries.join(example_texts(exemplars, word="例子", answer="答案"), "query_id", "left")
    return q.select("query_id", fill(template, TASK_DESCRIPTION=F.lit(row["task_text"]),
                                     RESPONSE_FORMAT=F.lit(row["answer_format"]), EXAMPLE=F.col("example"),
                                     DETAIL=F.col("detail")).alias("prompt"))


def chat_messages(prompt: Column, system: str | None = "You are a helpful assistant.") -> Column:
    """Messages as ``array<struct<role, content>>``."""
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    if system is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user)


def typed_messages(prompt: Column) -> Column:
    """One user message whose content is a list of typed parts."""
    part = F.struct(F.lit("text").alias("type"), prompt.alias("text"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part).alias("content")))


def sft_target(label: Column) -> Column:
    """Target text of a fine-tuning pair: ``1`` becomes ``1.0``."""
    return F.concat(label.cast("int").cast("string"), F.lit(".0"))


def sft_pairs(prompt_ids: Column, target_ids: Column, max_len: int, max_target: int | None = None) -> Column:
    """Struct of ``input_ids``, ``attention_mask`` and ``labels`` (-100 over the prompt), cut to ``max_len``; ``max_target``
    limits the target alone."""
    prompt = F.slice(prompt_ids, 1, max_len)
    joined = F.slice(F.concat(prompt, F.slice(target_ids, 1, min(max_target or max_len, max_len))), 1, max_len)
    n = F.size(prompt)
    labels = F.concat(F.array_repeat(F.lit(-100), n), F.slice(joined, n + 1, F.greatest(F.size(joined) - n, F.lit(0))))
    return F.struct(joined.alias("input_ids"), F.array_repeat(F.lit(1), F.size(joined)).alias("attention_mask"),
                    labels.alias("labels"))
