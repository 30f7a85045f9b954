"""Rendering, parsing, entropy of spans, fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from cohortflow.functions import answers
from cohortflow.operators import entropy, metrics, rendering, splits
from cohortflow.operators.joins import lookup
from cohortflow.operators.vectors import l2_normalize
from cohortflow.plans import catalogue, evaluate
from cohortflow.session import work_folder
from cohortflow.sources import tables
from cohortflow.sources.episodes import channel_header, pool, read_questions, visits

from .base import CHANNELS, DAY, OBS, PRED, SEED, curve_sql, observations, predictions, query, r6, sql_hash, table

UNITS = {"click": "Unit: n.", "error": "Unit: /.", "purchase": "Unit: EUR.", "signup": "Unit: /.", "view": "Unit: n."}
RANGES = {c: f"Reference range: 0 - {100 + i}." for i, c in enumerate(CHANNELS)}


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DETAIL = f"""{OBS},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stay_id, CAST(trunc(hours / 24) AS INTEGER) ORDER BY row_no DESC) AS rn FROM obs) WHERE rn = 1),
det AS (SELECT stay_id, {" || chr(10) || ".join(
    sql_text(f"- {c} ({UNITS[c]} {RANGES[c]}): [") + f" || string_agg(CASE WHEN channel = '{c}' AND raw IS NOT NULL THEN CAST(raw AS VARCHAR) ELSE 'NaN' END, ', ' ORDER BY row_no) || ']'"
    for c in CHANNELS)} AS detail, list(hours ORDER BY row_no) AS times FROM kept GROUP BY stay_id)"""


def _detail(spark, sf):
    return rendering.render_detail(observations(spark, sf), CHANNELS, UNITS, RANGES, bucket=DAY)


@query("render_detail", f"WITH {DETAIL} SELECT stay_id, detail FROM det")
def render_detail(spark, sf):
    return _detail(spark, sf).select("stay_id", "detail")


@query("render_visits", """
WITH v AS (SELECT vec_id, pos, step, CASE WHEN embedding[(step - 1) * 4 + pos] < -0.1 THEN 'NaN'
             ELSE CAST(CAST(floor(embedding[(step - 1) * 4 + pos] * 1000) AS INTEGER) AS VARCHAR) END AS c
           FROM embeddings CROSS JOIN (SELECT unnest(range(1, 5)) AS pos) CROSS JOIN (SELECT unnest(range(1, 17)) AS step)),
l AS (SELECT vec_id, pos, '- ' || ['Sex', 'Age', 'labtest_features[0]', 'labtest_features[1]'][pos] || ': [' || string_agg(c, ', ' ORDER BY step) || ']' AS line FROM v GROUP BY vec_id, pos)
SELECT vec_id, string_agg(line, chr(10) ORDER BY pos) AS detail FROM l GROUP BY vec_id""")
def render_visits(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(
        F.slice("embedding", i * 4 + 1, F.lit(4)),
        lambda v: F.when(v < -0.1, "nan").otherwise(F.floor(v * 1000).cast("int").cast("string"))))
    header = channel_header(F.lit(None).cast("array<string>"), 2)
    return e.select("vec_id", rendering.render_visits(x, header, any_missing=True).alias("detail"))


@query("visit_records", """
WITH v AS (SELECT vec_id, label, CASE WHEN label = 9 THEN 15 ELSE 16 END AS width FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS name, 4 AS t, label AS y, 16 AS n_cols FROM v WHERE width = 16""")
def visit_records(spark, sf):
    e = table(spark, sf, "embeddings")
    size = F.when(F.col("label") == 9, 15).otherwise(16)
    x = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding").cast("array<string>"), i * 16 + 1, size))
    times = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("double"))
    rec = e.select(F.col("vec_id").cast("string").alias("id"), x.alias("x_llm_ts"), times.alias("record_time"),
                   F.array(F.col("embedding")).cast("array<array<double>>").alias("x_ts"),
                   F.lit(None).cast("array<array<int>>").alias("missing_mask"), F.array("label", "vec_id").alias("y_mortality"))
    return visits(rec, "mortality", 16).select("name", "t", "y", F.size(F.col("x")[0]).alias("n_cols"))


@query("pool_listings", """
SELECT part, count(*) AS n FROM (SELECT 'train' AS part FROM customer UNION ALL SELECT 'val' FROM supplier UNION ALL SELECT 'test' FROM nation) GROUP BY part""")
def pool_listings(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(p).alias("part")) for t, p in (("customer", "train"), ("supplier", "val"), ("nation", "test"))]
    return pool(*parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def fill_sql(template: str, **values: str) -> str:
    import re
    parts = re.split(r"\{([A-Z_]+)\}", template)
    return " || ".join(f"({values[p]})" if i % 2 else sql_text(p) for i, p in enumerate(parts) if i % 2 or p)


def _prompt_sql(template, example, tail=""):
    row = catalogue.task_row("icu_los")
    return fill_sql(template, LENGTH="CAST(len(times) AS VARCHAR)", RECORD_TIME_LIST="(SELECT string_agg(printf('%.2f', h), ', ' ORDER BY i) FROM (SELECT unnest(times) AS h, unnest(range(len(times))) AS i))",
                    TASK_DESCRIPTION=sql_text(row["task_text"]), RESPONSE_FORMAT=sql_text(row["answer_format"]), EXAMPLE=example, DETAIL="detail") + tail


# The examples of a stay are the next two stays by id; labels and logits come from counts of the text.
EXAMPLES = f"""{DETAIL},
ex AS (SELECT d.stay_id AS query_id, r.rank, e.detail, len(e.times) % 5 AS label, [len(e.times) / 10.0, 1.0, length(e.detail) / 400.0, 0.5] AS z
       FROM det d CROSS JOIN (SELECT unnest([1, 2]) AS rank) r JOIN det e ON e.stay_id = d.stay_id + r.rank),
exs AS (SELECT query_id, string_agg('Example ' || rank || ':' || chr(10) || detail || chr(10) || 'Expert Model Outputs: ' || chr(CAST(64 + list_position(z, list_max(z)) AS INTEGER))
          || chr(10) || 'Label: ' || CASE WHEN label < 4 THEN chr(CAST(65 + label AS INTEGER)) ELSE CAST(label AS VARCHAR) END, chr(10) || chr(10) ORDER BY rank) AS example FROM ex GROUP BY query_id),
q AS (SELECT d.*, coalesce(example, '') AS example, [len(times) / 10.0, 1.0, length(d.detail) / 400.0, 0.5] AS z FROM det d LEFT JOIN exs ON exs.query_id = d.stay_id)"""


def _prompt_inputs(spark, sf):
    d = _detail(spark, sf).withColumn("logits", F.array(
        F.size("times") / 10.0, F.lit(1.0), F.length("detail") / 400.0, F.lit(0.5)))
    q = d.withColumnRenamed("stay_id", "query_id")
    picks = d.select(F.col("stay_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).withColumn(
        "stay_id", F.col("query_id") + F.col("rank"))
    ex = picks.join(d, "stay_id").withColumn("label", F.size("times") % 5)
    return q, ex


@query("render_prompt", f"""WITH {EXAMPLES}
SELECT stay_id AS query_id, md5({_prompt_sql(catalogue.ZERO_SHOT, "''")}) AS zero_shot,
       {_prompt_sql(catalogue.FEW_SHOT_EXPERT, 'example')} || chr(10) || 'Expert Model Outputs: ' || chr(CAST(64 + list_position(z, list_max(z)) AS INTEGER))
         || chr(10) || 'Give the expert model''s output the most weight, and answer in the manner of the examples above:' AS few_shot FROM q""")
def render_prompt(spark, sf):
    q, ex = _prompt_inputs(spark, sf)
    zero = rendering.render_prompt(q, "icu_los").select("query_id", F.md5("prompt").alias("zero_shot"))
    few = rendering.render_prompt(q, "icu_los", ex, "letter", "letter", "letter")
    return zero.join(few.withColumnRenamed("prompt", "few_shot"), "query_id")


@query("scored_span", """
WITH p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Some intro words' || chr(10) || 'Clinical Features Over Time:' || chr(10) || text || chr(10) || 'Label:'
             WHEN lang = 'fr' THEN 'Only three words ' || text || ' Label: x Label: y' ELSE 'One Label: ' || reverse(text) || ' Label: ' || lang END AS prompt, lang,
           len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 3 ELSE n + 2 END AS mask_start, CASE lang WHEN 'en' THEN 8 + n WHEN 'fr' THEN 6 + n ELSE n + 3 END AS mask_end FROM p""")
def scored_span(spark, sf):
    d = table(spark, sf, "documents")
    prompt = (F.when(F.col("lang") == "en", F.concat(F.lit("Some intro words\n" + entropy.MARKER), "text", F.lit("\nLabel:")))
              .when(F.col("lang") == "fr", F.concat(F.lit("Only three words "), "text", F.lit(" Label: x Label: y")))
              .otherwise(F.concat(F.lit("One Label: "), F.reverse("text"), F.lit(" Label: "), "lang")))
    return d.select("doc_id", entropy.scored_span(prompt, F.col("text")).alias("s")).select("doc_id", "s.*")


LOGP = """
lp AS (SELECT user_id AS prompt_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE WHEN value >= 8 THEN -value / 100 END AS logprob FROM events),
ps AS (SELECT prompt_id, count(*) // 4 AS mask_start, count(*) - 5 AS mask_end, count(*) - 8 AS len FROM lp GROUP BY prompt_id)"""


def _logprobs(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    lp = table(spark, sf, "events").select(
        F.col("user_id").alias("prompt_id"), (F.row_number().over(w) - 1).alias("pos"),
        F.when(F.col("value") >= 8, -F.col("value") / 100).alias("logprob"))
    n = F.count(F.lit(1))
    return lp, lp.groupBy("prompt_id").agg(F.floor(n / 4).alias("mask_start"), (n - 5).alias("mask_end"), (n - 8).alias("len"))


@query("prompt_entropy", f"""WITH {LOGP}
SELECT ps.prompt_id, round(coalesce(avg(-logprob), CAST('inf' AS DOUBLE)), 10) AS entropy FROM ps
LEFT JOIN lp ON lp.prompt_id = ps.prompt_id AND pos >= mask_start + 1 AND pos < least(mask_end, len) AND logprob IS NOT NULL GROUP BY 1""")
def prompt_entropy(spark, sf):
    return entropy.prompt_entropy(*_logprobs(spark, sf)).select("prompt_id", F.round("entropy", 10).alias("entropy"))


@query("prompt_entropy_sum", f"""WITH {LOGP}
SELECT ps.prompt_id, round(coalesce(sum(-logprob), 0.0), 6) AS entropy FROM ps
LEFT JOIN lp ON lp.prompt_id = ps.prompt_id AND pos >= mask_start + 1 AND pos < least(mask_end + 1, len) AND logprob IS NOT NULL GROUP BY 1""")
def prompt_entropy_sum(spark, sf):
    return entropy.prompt_entropy(*_logprobs(spark, sf), reduce="sum").select("prompt_id", r6("entropy"))


@query("render_question", """
SELECT p_partkey, '题型：' || p_type || chr(10) || '题目：' || p_name || chr(10) || chr(10) || '可选答案：' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || CAST(p_size AS VARCHAR) || chr(10) || chr(10) AS detail FROM part""")
def render_question(spark, sf):
    option = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", rendering.render_question(F.col("p_type"), F.col("p_name"), option).alias("detail"))


_EXAM = catalogue.task_row("exam")


@query("render_question_prompt", f"""
WITH ex AS (SELECT n_regionkey AS query_id, string_agg('例子 ' || (n_nationkey // 5 + 1) || ':' || chr(10) || n_name || chr(10) || '答案: ' || CAST(n_nationkey AS VARCHAR), chr(10) || chr(10) ORDER BY n_nationkey // 5 + 1) AS example
            FROM nation GROUP BY 1)
SELECT r_regionkey AS query_id, {fill_sql(catalogue.QUESTION_FEW_SHOT, TASK_DESCRIPTION=sql_text(_EXAM["task_text"]), RESPONSE_FORMAT=sql_text(_EXAM["answer_format"]), EXAMPLE="example", DETAIL="r_name")} AS prompt
FROM region JOIN ex ON query_id = r_regionkey""")
def render_question_prompt(spark, sf):
    q = table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("detail"))
    ex = table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("query_id"), (F.floor(F.col("n_nationkey") / 5) + 1).alias("rank"),
        F.col("n_name").alias("detail"), F.col("n_nationkey").alias("label"))
    return rendering.render_question_prompt(q, ex)


@query("chat_messages", """
SELECT conv_id, turn, 'system' AS role0, 'You are a helpful assistant.' AS content0, 'user' AS role1, text AS content1, 'text' AS part_type, text AS part_text FROM conversations""")
def chat_messages(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", rendering.chat_messages(F.col("text")).alias("m"), rendering.typed_messages(F.col("text")).alias("t"))
    part = F.col("t")[0]["content"][0]
    return c.select("conv_id", "turn", F.col("m")[0]["role"].alias("role0"), F.col("m")[0]["content"].alias("content0"),
                    F.col("m")[1]["role"].alias("role1"), F.col("m")[1]["content"].alias("content1"),
                    part["type"].alias("part_type"), part["text"].alias("part_text"))


@query("sft_pairs", """
WITH t AS (SELECT doc_id, lang = 'en' AS y, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w))[1:500] AS p FROM documents),
j AS (SELECT doc_id, y, len(p) AS n, list_concat(p, [7, 8, 9])[1:500] AS ids FROM t)
SELECT doc_id, CAST(y AS INTEGER) || '.0' AS target, len(ids) AS n_ids, CAST(list_sum(ids) AS BIGINT) AS ids_sum, len(ids) AS n_mask,
       CAST(-100 * n + coalesce(list_sum(ids[n + 1:]), 0) AS BIGINT) AS labels_sum FROM j""")
def sft_pairs(spark, sf):
    d = table(spark, sf, "documents")
    ids = F.transform(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != ""), F.length)
    pair = rendering.sft_pairs(ids, F.array(F.lit(7), F.lit(8), F.lit(9)), 500)

    def total(c):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)

    return d.select("doc_id", rendering.sft_target(F.col("lang") == "en").alias("target"), pair.alias("p")).select(
        "doc_id", "target", F.size("p.input_ids").cast("bigint").alias("n_ids"), total(F.col("p.input_ids")).alias("ids_sum"),
        F.size("p.attention_mask").cast("bigint").alias("n_mask"), total(F.col("p.labels")).alias("labels_sum"))


# ---- parsing -------------------------------------------------------------------------------------------------------

RESP = """
resp AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber
  WHEN 1 THEN '<think>' || CAST(l_tax AS VARCHAR) || '</think> risk is ' || CAST(l_discount AS VARCHAR)
  WHEN 2 THEN CAST(l_quantity AS VARCHAR) || ' of 100, so ' || CAST(l_discount AS VARCHAR) || ' then ' || CAST(l_extendedprice AS VARCHAR)
  WHEN 3 THEN 'about ' || CAST(l_quantity + 1 AS VARCHAR) || ' or -' || CAST(l_extendedprice AS VARCHAR)
  WHEN 4 THEN 'no idea' WHEN 5 THEN '<think>0.3' || chr(10) || '0.4</think>' WHEN 6 THEN 'p=' || CAST(l_tax AS VARCHAR) || '%'
  ELSE 'x' || CAST(l_discount AS VARCHAR) || '.5' END AS response FROM lineitem)"""


def _responses(spark, sf):
    n = F.col("l_linenumber")

    def s(c):
        return F.col(c).cast("string")

    text = (F.when(n == 1, F.concat(F.lit("<think>"), s("l_tax"), F.lit("</think> risk is "), s("l_discount")))
            .when(n == 2, F.concat(s("l_quantity"), F.lit(" of 100, so "), s("l_discount"), F.lit(" then "), s("l_extendedprice")))
            .when(n == 3, F.concat(F.lit("about "), (F.col("l_quantity") + 1).cast("string"), F.lit(" or -"), s("l_extendedprice")))
            .when(n == 4, "no idea").when(n == 5, "<think>0.3\n0.4</think>")
            .when(n == 6, F.concat(F.lit("p="), s("l_tax"), F.lit("%"))).otherwise(F.concat(F.lit("x"), s("l_discount"), F.lit(".5"))))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", text.alias("response"))


@query("parse_probability", f"""WITH {RESP},
n AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(response, '<think>.*?</think>', '', 'gs'), '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS v FROM resp)
SELECT l_orderkey, l_linenumber, l_quantity, response, coalesce(list_filter(v, lambda x: x >= 0 AND x <= 1)[-1], v[1], -1.0) AS p FROM n""")
def parse_probability(spark, sf):
    return _responses(spark, sf).withColumn("p", answers.parse_probability(F.col("response")))


LETTERS = """
ans AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CASE l_linenumber
  WHEN 1 THEN '  ' || lower(l_returnflag) || ' is my pick' WHEN 2 THEN '*so (' || l_returnflag || ') it is'
  WHEN 3 THEN '1. answer: ' || l_returnflag WHEN 4 THEN '# think of ' || l_returnflag || ' here' WHEN 5 THEN '12 34'
  WHEN 6 THEN '<think>D</think> [' || l_linestatus || '] wins' ELSE '' END AS response FROM lineitem)"""


def _letters(spark, sf):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    text = (F.when(n == 1, F.concat(F.lit("  "), F.lower(flag), F.lit(" is my pick"))).when(n == 2, F.concat(F.lit("*so ("), flag, F.lit(") it is")))
            .when(n == 3, F.concat(F.lit("1. answer: "), flag)).when(n == 4, F.concat(F.lit("# think of "), flag, F.lit(" here")))
            .when(n == 5, "12 34").when(n == 6, F.concat(F.lit("<think>D</think> ["), F.col("l_linestatus"), F.lit("] wins"))).otherwise(""))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", text.alias("response"))


def letter_sql(text: str, letters: str, words: str) -> str:
    tries = [f"regexp_extract(u, '^([{letters}])', 1)", f"regexp_extract(u, '[\\(\\[]([{letters}])[\\)\\]]', 1)",
             f"regexp_extract(u, '(?i)(?:{words})[:\\s]*([{letters}])', 1)", f"regexp_extract(substr(u, 1, 50), '\\b([{letters}])\\b', 1)"]
    return f"(SELECT coalesce({', '.join(f'''nullif({t}, '')''' for t in tries)}) FROM (SELECT upper(trim({text})) AS u))"


@query("parse_letter_ad", f"""WITH {LETTERS}
SELECT l_orderkey, l_linenumber, response, {letter_sql('response', 'A-D', 'answer|option|choice|category')} AS letter FROM ans""")
def parse_letter_ad(spark, sf):
    return _letters(spark, sf).select("l_orderkey", "l_linenumber", "response", answers.parse_letter_ad(F.col("response")).alias("letter"))


AZ = letter_sql("regexp_replace(response, '<think>.*?</think>', '', 'gs')", "A-Z", "answer|option|choice")


@query("parse_letter_az", f"WITH {LETTERS} SELECT l_orderkey, l_linenumber, response, {AZ} AS letter FROM ans")
def parse_letter_az(spark, sf):
    return _letters(spark, sf).select("l_orderkey", "l_linenumber", "response", answers.parse_letter_az(F.col("response")).alias("letter"))


@query("choice_validity", f"""WITH {LETTERS}, p AS (SELECT *, {AZ} AS letter FROM ans)
SELECT l_linestatus, count(letter) AS n_valid, count(*) - count(letter) AS n_dropped,
       round(sum(CAST(letter = l_returnflag AS INTEGER)) / count(letter), 6) AS accuracy FROM p GROUP BY 1""")
def choice_validity(spark, sf):
    p = _letters(spark, sf).withColumn("letter", answers.parse_letter_az(F.col("response")))
    v = metrics.choice_validity(p, "letter", "l_returnflag", ["l_linestatus"])
    return v.select("l_linestatus", "n_valid", "n_dropped", r6("accuracy"))


@query("response_report", f"""WITH {PRED}, r AS (SELECT CASE WHEN l_linenumber = 7 THEN -1.0 ELSE coarse END AS s, label FROM pred),
inv AS (SELECT 1 - s AS score, 1 - label AS label FROM r), {curve_sql('inv', 'score', 'label')}
SELECT 'inverted' AS report, 'auroc' AS metric, round(sum(neg * (tp - pos + pos / 2)) / max(np * nn), 6) AS value FROM curve
UNION ALL SELECT 'inverted', 'auprc', round(sum(pos / np * p), 6) FROM curve
UNION ALL SELECT 'recall_point', 'threshold', round(max(s) FILTER (r >= 0.9), 6) FROM curve
UNION ALL SELECT 'plain', 'brier', round(avg((s - label) * (s - label)), 6) FROM r
UNION ALL SELECT 'answers', 'n', count(*) FROM r UNION ALL SELECT 'answers', 'unread', count(*) FILTER (s < 0) FROM r""")
def response_report(spark, sf):
    said = F.when(F.col("l_linenumber") == 7, "no idea").otherwise(F.concat(F.lit("<think>3 of 7</think> My estimate: "), F.col("coarse").cast("string")))
    report = evaluate.response_metrics(predictions(spark, sf).withColumn("said", said), "mortality", "said", "label")
    wanted = F.concat_ws(".", "report", "metric").isin("inverted.auroc", "inverted.auprc", "recall_point.threshold", "plain.brier", "answers.n", "answers.unread")
    return report.where(wanted).select("report", "metric", r6("value"))


@query("strip_prompt", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(text, ' ' || chr(10)) ELSE 'and ' || role END AS answer FROM conversations""")
def strip_prompt(spark, sf):
    c = table(spark, sf, "conversations")
    whole = F.when(F.col("role") == "user", F.col("text")).otherwise(
        F.concat("text", F.lit(" first "), "text", F.lit("  and "), "role", F.lit("\n")))
    prompt = F.when(F.col("role") == "user", F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", answers.strip_prompt(whole, prompt).alias("answer"))


SCORES = """
sc0 AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value FROM events),
sc AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE k / 100 END AS a, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE value / 500 END AS b,
         event_type FROM sc0)"""


def _scores(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "map<string,double>")["k"] / 100
    full = F.create_map(F.lit("A"), k, F.lit("B"), F.col("value") / 500)
    m = (F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", F.create_map(F.lit("A"), k)).otherwise(full))
    return e.select("event_id", m.alias("m"))


@query("option_vector", f"""WITH {SCORES}
SELECT event_id, round(CASE WHEN coalesce(a, 0) + coalesce(b, 0) <= 0 THEN 0.25 ELSE coalesce(a, 0) / (coalesce(a, 0) + coalesce(b, 0)) END, 6) AS pa,
       round(CASE WHEN coalesce(a, 0) + coalesce(b, 0) <= 0 THEN 0.25 ELSE coalesce(b, 0) / (coalesce(a, 0) + coalesce(b, 0)) END, 6) AS pb,
       CASE WHEN coalesce(a, 0) + coalesce(b, 0) <= 0 THEN 0.25 ELSE 0.0 END AS pc FROM sc""")
def option_vector(spark, sf):
    v = answers.option_vector(F.col("m"), ["A", "B", "C", "D"])
    return _scores(spark, sf).select("event_id", v.alias("v")).select(
        "event_id", r6(F.col("v")[0], "pa"), r6(F.col("v")[1], "pb"), F.col("v")[2].alias("pc"))


@query("option_probs", f"""WITH {SCORES}
SELECT event_id, round(CASE WHEN event_type = 'view' THEN 0.25 ELSE exp(a) / (exp(a) + coalesce(exp(b), 0)) END, 6) AS pa,
       round(CASE WHEN event_type = 'view' THEN 0.25 ELSE coalesce(exp(b), 0) / (exp(a) + coalesce(exp(b), 0)) END, 6) AS pb,
       CASE WHEN event_type = 'view' THEN 0.25 ELSE 0.0 END AS pc FROM sc""")
def option_probs(spark, sf):
    v = answers.option_probs(F.col("m"), ["A", "B", "C", "D"])
    return _scores(spark, sf).select("event_id", v.alias("v")).select(
        "event_id", r6(F.col("v")[0], "pa"), r6(F.col("v")[1], "pb"), F.col("v")[2].alias("pc"))


@query("fingerprint", """
WITH r AS (SELECT lang AS split, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) AS piece, md5(CAST(doc_id AS VARCHAR) || '|' || md5(text)) AS h FROM documents),
p AS (SELECT split, piece, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1, 2)
SELECT split, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(d, '' ORDER BY piece)) AS digest FROM p GROUP BY split""")
def fingerprint(spark, sf):
    return tables.fingerprint(table(spark, sf, "documents"), "doc_id", "text", "lang")


@query("lookup", """
SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def lookup_query(spark, sf):
    dim = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return lookup(table(spark, sf, "customer"), dim, "c_nationkey").select("c_custkey", "n_name", "n_regionkey")


# ---- stored tables -------------------------------------------------------------------------------------------------

def _fresh_folder(spark):
    return f"{work_folder(spark)}/cohortflow/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}"


@query("stored_embeddings", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12), 6) AS u1 FROM embeddings""")
def stored_embeddings(spark, sf):
    """Computed once under the key of the texts, then read back under the same key."""
    e = table(spark, sf, "embeddings")
    prints = tables.fingerprint(table(spark, sf, "documents"), "doc_id", "text", "lang")
    key, base = tables.cache_key(prints, {"vectors": "unit"}), _fresh_folder(spark)

    def compute():
        return e.select("vec_id", l2_normalize(F.col("embedding")).alias("vec"))

    tables.cached(spark, base, key, ["vec_id", "vec"], compute)
    found = tables.cached(spark, base, key, ["vec_id", "vec"], lambda: e.limit(0))
    return found.select("vec_id", r6(F.col("vec")[0], "u1"))


@query("prepared_table", f"""
WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY {sql_hash('c_custkey', str(SEED))}, c_custkey) - 1 AS rank0, count(*) OVER () AS n FROM customer)
SELECT CASE WHEN rank0 < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rank0 < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * ((1 - CAST(0.8 AS DOUBLE)) / 2)) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, round(sum(c_acctbal), 2) AS total FROM r GROUP BY 1""")
def prepared_table(spark, sf):
    base = _fresh_folder(spark)
    rows = splits.split_ratio(table(spark, sf, "customer"), "c_custkey", 0.8, SEED)
    tables.write_prepared(rows, base, "customers", SEED, 48)
    back = tables.read_prepared(spark, base, "customers", SEED, 48)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("question_file", """
SELECT p_type AS question_type, p_name AS question, p_brand AS option_a, CAST(p_size AS VARCHAR) AS option_b FROM part""")
def question_file(spark, sf):
    """Parts written as question lines and read by the question source."""
    path = _fresh_folder(spark)
    option = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_size").cast("string"))
    table(spark, sf, "part").select(F.col("p_type").alias("question_type"), F.col("p_name").alias("question"),
                                    option.alias("option")).write.json(path)
    q = read_questions(spark, path)
    return q.select("question_type", "question", F.col("option")["A"].alias("option_a"), F.col("option")["B"].alias("option_b"))


@query("metric_file", f"""WITH {PRED}
SELECT l_linestatus, round(avg((score - label) * (score - label)), 6) AS brier FROM pred GROUP BY 1""")
def metric_file(spark, sf):
    path = _fresh_folder(spark)
    tables.write_metrics(metrics.brier(predictions(spark, sf), "score", "label", ["l_linestatus"]), path)
    return spark.read.schema("l_linestatus string, brier double").json(path).select("l_linestatus", r6("brier"))
