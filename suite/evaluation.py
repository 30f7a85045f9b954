"""Metrics, bootstrap, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import scalars
from cohortflow.operators import bootstrap, metrics
from cohortflow.plans.evaluate import task_metrics

from .base import PRED, SEED, curve_sql, predictions, query, r6, sql_hash, sql_uniform, table

CONF_SQL = f"""WITH {PRED}, c AS (SELECT l_linestatus, sum(CAST(NOT h AND label = 0 AS INTEGER)) AS tn, sum(CAST(h AND label = 0 AS INTEGER)) AS fp,
   sum(CAST(NOT h AND label = 1 AS INTEGER)) AS fn, sum(CAST(h AND label = 1 AS INTEGER)) AS tp FROM (SELECT *, coarse @op 0.5 AS h FROM pred) GROUP BY 1)
SELECT l_linestatus, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
   round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
   round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""


def _conf(df):
    return df.select("l_linestatus", "tn", "fp", "fn", "tp", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query("confusion_at", CONF_SQL.replace("@op", ">="))
def confusion_at(spark, sf):
    return _conf(metrics.confusion_at(predictions(spark, sf), "coarse", "label", 0.5, by=["l_linestatus"]))


@query("confusion_strict", CONF_SQL.replace("@op", ">"))
def confusion_strict(spark, sf):
    return _conf(metrics.confusion_at(predictions(spark, sf), "coarse", "label", 0.5, True, by=["l_linestatus"]))


CURVE = f"WITH {PRED}, {curve_sql('pred', 'score', 'label', 'l_linestatus')}"
COARSE = f"WITH {PRED}, {curve_sql('pred', 'coarse', 'label')}"


@query("roc_auc", f"""{CURVE}
SELECT l_linestatus, round(sum(neg * (tp - pos + pos / 2)) / max(np * nn), 6) AS roc_auc FROM curve GROUP BY 1""")
def roc_auc(spark, sf):
    return metrics.roc_auc(predictions(spark, sf), "score", "label", ["l_linestatus"]).select("l_linestatus", r6("roc_auc"))


@query("roc_auc_ties", f"{COARSE} SELECT round(sum(neg * (tp - pos + pos / 2)) / max(np * nn), 6) AS roc_auc FROM curve")
def roc_auc_ties(spark, sf):
    return metrics.roc_auc(predictions(spark, sf), "coarse", "label").select(r6("roc_auc"))


@query("average_precision", f"""{CURVE}
SELECT l_linestatus, round(sum(pos / np * p), 6) AS average_precision FROM curve GROUP BY 1""")
def average_precision(spark, sf):
    return metrics.average_precision(predictions(spark, sf), "score", "label", ["l_linestatus"]).select(
        "l_linestatus", r6("average_precision"))


@query("pr_auc_trapezoid", f"""{CURVE},
z AS (SELECT l_linestatus, r - coalesce(lag(r) OVER w, 0) AS dr, p + coalesce(lag(p) OVER w, 1) AS pp FROM curve
      WINDOW w AS (PARTITION BY l_linestatus ORDER BY s DESC))
SELECT l_linestatus, round(sum(dr * pp / 2), 6) AS pr_auc FROM z GROUP BY 1""")
def pr_auc_trapezoid(spark, sf):
    return metrics.pr_auc_trapezoid(predictions(spark, sf), "score", "label", ["l_linestatus"]).select("l_linestatus", r6("pr_auc"))


BEST = """, f AS (SELECT s, 2 * p * r / (p + r + 1e-8) AS f FROM curve)
SELECT round(f, 6) AS f1, round(s, 6) AS threshold FROM f ORDER BY f.f DESC, s LIMIT 1"""


@query("best_f1", f"{COARSE}{BEST}")
def best_f1(spark, sf):
    return metrics.best_f1(predictions(spark, sf), "coarse", "label").select(r6("f1"), r6("threshold"))


@query("min_pse", f"{CURVE} SELECT l_linestatus, round(max(least(p, r)), 6) AS min_pse FROM curve GROUP BY 1")
def min_pse(spark, sf):
    return metrics.min_pse(predictions(spark, sf), "score", "label", ["l_linestatus"]).select("l_linestatus", r6("min_pse"))


@query("brier", f"WITH {PRED} SELECT l_linestatus, round(avg((score - label) * (score - label)), 6) AS brier FROM pred GROUP BY 1")
def brier(spark, sf):
    return metrics.brier(predictions(spark, sf), "score", "label", ["l_linestatus"]).select("l_linestatus", r6("brier"))


@query("recall_point", f"""{CURVE},
t AS (SELECT l_linestatus, max(s) AS threshold FROM curve WHERE r >= 0.9 GROUP BY 1)
SELECT t.l_linestatus, round(threshold, 6) AS threshold, CAST(nn - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(np - tp AS BIGINT) AS fn,
   CAST(tp AS BIGINT) AS tp, round(p, 6) AS precision, round(r, 6) AS recall FROM curve c JOIN t ON c.l_linestatus = t.l_linestatus AND s = threshold""")
def recall_point(spark, sf):
    p = metrics.recall_point(predictions(spark, sf), "score", "label", 0.9, ["l_linestatus"])
    return p.select("l_linestatus", r6("threshold"), "tn", "fp", "fn", "tp", r6("precision"), r6("recall"))


INV = f"{PRED}, inv AS (SELECT l_linestatus, 1 - score AS score, 1 - label AS label FROM pred)"


@query("inverted_eval", f"""WITH {INV}, {curve_sql('inv', 'score', 'label')}
SELECT round(sum(neg * (tp - pos + pos / 2)) / max(np * nn), 6) AS auroc, round(sum(pos / np * p), 6) AS auprc,
       round(max(least(p, r)), 6) AS minpse, round(sum(pos * (s - 1) * (s - 1) + neg * s * s) / max(np + nn), 6) AS brier FROM curve""")
def inverted_eval(spark, sf):
    inv = metrics.inverted(predictions(spark, sf), "score", "label")
    return metrics.binary_metrics(inv, "score", "label").select(r6("auroc"), r6("auprc"), r6("minpse"), r6("brier"))


@query("regression_metrics", """
WITH t AS (SELECT o_orderstatus, o_totalprice AS y, 250000 + o_custkey / 10.0 AS p FROM orders)
SELECT o_orderstatus, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse,
       round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2 FROM t GROUP BY 1""")
def regression_metrics(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.lit(250000) + F.col("o_custkey") / F.lit(10.0))
    m = metrics.regression_metrics(o, "p", "o_totalprice", ["o_orderstatus"])
    return m.select("o_orderstatus", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), r6("r2"))


@query("label_histogram", """
SELECT s.l_linestatus, c.class, count(l.l_linenumber) AS n FROM (SELECT DISTINCT l_linestatus FROM lineitem) s
CROSS JOIN (SELECT unnest(range(0, 10)) AS class) c LEFT JOIN lineitem l ON l.l_linestatus = s.l_linestatus AND l.l_linenumber = c.class GROUP BY 1, 2""")
def label_histogram(spark, sf):
    h = metrics.label_histogram(table(spark, sf, "lineitem"), "l_linenumber", 10, ["l_linestatus"])
    return h.select("l_linestatus", F.col("class").cast("bigint").alias("class"), "n")


def _classes(spark, sf):
    """Vectors as 10-class logits: the first ten entries."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("probs"))


SOFT = """
lg AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda z: CAST(z AS DOUBLE)) AS z FROM embeddings),
ex AS (SELECT vec_id, label, list_transform(z, lambda q: exp(q - list_max(z))) AS w FROM lg),
sm AS (SELECT vec_id, label, list_transform(w, lambda q: q / list_sum(w)) AS p FROM ex),
rows AS (SELECT vec_id, label AS y, unnest(p) AS score, unnest(range(0, 10)) AS class FROM sm),
oc AS (SELECT class, score, CAST(class = y AS INTEGER) AS hit FROM rows)"""


@query("ovr_auc", f"""WITH {SOFT},
pc AS (SELECT class, score AS s, sum(hit) AS pos, sum(1 - hit) AS neg FROM oc GROUP BY 1, 2),
cc AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY s DESC) AS tp, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn FROM pc),
per AS (SELECT class, sum(neg * (tp - pos + pos / 2)) / max(np * nn) AS auc, max(np) AS np FROM cc GROUP BY class),
mc AS (SELECT score AS s, sum(hit) AS pos, sum(1 - hit) AS neg FROM oc GROUP BY 1),
mm AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM mc)
SELECT 'class_' || class AS scope, round(auc, 6) AS auc FROM per UNION ALL SELECT 'macro', round(avg(auc), 6) FROM per
UNION ALL SELECT 'weighted', round(sum(auc * np) / sum(np), 6) FROM per
UNION ALL SELECT 'micro', round(sum(neg * (tp - pos + pos / 2)) / max(np * nn), 6) FROM mm""")
def ovr_auc(spark, sf):
    d = metrics.as_probabilities(_classes(spark, sf), "probs")
    return metrics.ovr_auc(d, "probs", "label").select("scope", r6("auc"))


@query("multiclass_report", f"""WITH {SOFT},
hard AS (SELECT label AS y, list_position(p, list_max(p)) - 1 AS pr FROM sm),
k AS (SELECT class, count(*) FILTER (y = class AND pr = class) AS tp, count(*) FILTER (y = class) AS sup, count(*) FILTER (pr = class) AS prd
      FROM hard CROSS JOIN (SELECT unnest(range(0, 10)) AS class) GROUP BY class),
h AS (SELECT class, count(*) FILTER (hit = 1 AND score >= 0.5) AS tp, sum(hit) AS sup, count(*) FILTER (score >= 0.5) AS prd FROM oc GROUP BY class)
SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(tp) / sum(sup), 6) AS f1_micro, round(avg(CASE WHEN sup + prd = 0 THEN 0 ELSE 2 * tp / (sup + prd) END), 6) AS f1_macro,
       (SELECT round(avg(CASE WHEN sup + prd = 0 THEN 0 ELSE 2 * tp / (sup + prd) END), 6) FROM h) AS f1_macro_half FROM k WHERE sup + prd > 0""")
def multiclass_report(spark, sf):
    d = metrics.as_probabilities(_classes(spark, sf), "probs")
    return metrics.multiclass_report(d, "probs", "label").select(r6("accuracy"), r6("f1_micro"), r6("f1_macro"), r6("f1_macro_half"))


@query("class_report", """
WITH h AS (SELECT l_linenumber AS y, CAST(least(floor(l_quantity / 7) + 1, 7) AS INTEGER) AS pr FROM lineitem),
k AS (SELECT c.class, count(*) FILTER (y = c.class AND pr = c.class) AS tp, count(*) FILTER (y = c.class) AS support, count(*) FILTER (pr = c.class) AS predicted
      FROM h CROSS JOIN (SELECT unnest(range(1, 8)) AS class) c GROUP BY 1)
SELECT CAST(class AS INTEGER) AS class, support, predicted, tp, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall,
       round(2 * tp / (predicted + support), 6) AS f1 FROM k""")
def class_report(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("pr", F.least(F.floor(F.col("l_quantity") / 7) + 1, F.lit(7)).cast("int"))
    r = metrics.class_report(li, "pr", "l_linenumber")
    return r.select("class", "support", "predicted", "tp", r6("precision"), r6("recall"), r6("f1"))


@query("confusion_matrix", """
SELECT l_linenumber AS label, CAST(least(floor(l_quantity / 7) + 1, 7) AS INTEGER) AS pred, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("pr", F.least(F.floor(F.col("l_quantity") / 7) + 1, F.lit(7)).cast("int"))
    return metrics.confusion_matrix(li, "pr", "l_linenumber")


# ---- bootstrap -----------------------------------------------------------------------------------------------------

DRAWS = 1000
BIN = "bin AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS score, CAST(label < 5 AS INTEGER) AS y FROM embeddings)"


def draw_sql(ids: str, draws: int = DRAWS, seed: int = 42) -> str:
    return f"""
nn0 AS (SELECT count(*) AS n FROM {ids}),
dr AS (SELECT b.generate_series AS replicate, CAST(floor({sql_uniform('b.generate_series', 'j.generate_series', str(seed))} * nn0.n) AS BIGINT) AS rank0
       FROM nn0 CROSS JOIN generate_series(0, {draws - 1}) b CROSS JOIN generate_series(0, (SELECT count(*) - 1 FROM {ids})) j),
rk AS (SELECT *, row_number() OVER (ORDER BY {sql_hash('vec_id', str(seed))}, vec_id) - 1 AS rank0 FROM {ids}),
smp AS (SELECT replicate, rk.* FROM dr JOIN rk USING (rank0))"""


def stats_sql(values: str) -> str:
    return f"""SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.025), 6) AS ci_lower, round(quantile_cont(v, 0.975), 6) AS ci_upper, count(v) AS n_bootstrap FROM {values} GROUP BY metric"""


def _rounded(df):
    return df.select("metric", r6("mean"), r6("std"), r6("median"), r6("ci_lower"), r6("ci_upper"), "n_bootstrap")


def _binary(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", ((F.col("embedding")[0].cast("double") + 1) / 2).alias("score"), (F.col("label") < 5).cast("int").alias("y"))


@query("bootstrap_ci", f"""WITH {BIN}, {draw_sql('bin')}, {curve_sql('smp', 'score', 'y', 'replicate')},
m AS (SELECT replicate, sum(neg * (tp - pos + pos / 2)) / max(np * nn) AS auroc, sum(pos / np * p) AS auprc, max(least(p, r)) AS minpse,
        max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS best_f1, sum(pos * (s - 1) * (s - 1) + neg * s * s) / max(np + nn) AS brier
      FROM curve GROUP BY replicate),
u AS (UNPIVOT m ON auroc, auprc, minpse, best_f1, brier INTO NAME metric VALUE v) {stats_sql('u')}""")
def bootstrap_ci(spark, sf):
    names = ["auroc", "auprc", "minpse", "best_f1", "brier"]
    return _rounded(bootstrap.bootstrap_binary(_binary(spark, sf), "score", "y", DRAWS, id_col="vec_id", names=names))


@query("bootstrap_ci_cells")
def bootstrap_ci_cells(spark, sf):
    return bootstrap.bootstrap_binary(predictions(spark, sf), "coarse", "label", DRAWS)


@query("bootstrap_regression", f"""WITH reg AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), {draw_sql('reg')},
m AS (SELECT replicate, avg(abs(p - y)) AS mae, avg((p - y) * (p - y)) AS mse, sqrt(avg((p - y) * (p - y))) AS rmse,
             1 - avg((p - y) * (p - y)) / var_pop(y) AS r2 FROM smp GROUP BY replicate),
u AS (UNPIVOT m ON mae, mse, rmse, r2 INTO NAME metric VALUE v) {stats_sql('u')}""")
def bootstrap_regression(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("p"), F.col("embedding")[1].cast("double").alias("y"))
    return _rounded(bootstrap.bootstrap_regression(e, "p", "y", DRAWS, id_col="vec_id"))


@query("bootstrap_multiclass", f"""WITH {SOFT}, {draw_sql('sm')},
rr AS (SELECT replicate, label AS y, list_position(p, list_max(p)) - 1 AS pr, unnest(p) AS score, unnest(range(0, 10)) AS class FROM smp),
oc2 AS (SELECT replicate, class, score, CAST(class = y AS INTEGER) AS hit, pr FROM rr),
pc AS (SELECT replicate, class, score AS s, sum(hit) AS pos, sum(1 - hit) AS neg FROM oc2 GROUP BY 1, 2, 3),
cc AS (SELECT *, sum(pos) OVER (PARTITION BY replicate, class ORDER BY s DESC) AS tp, sum(pos) OVER (PARTITION BY replicate, class) AS np, sum(neg) OVER (PARTITION BY replicate, class) AS nn FROM pc),
per AS (SELECT replicate, class, sum(neg * (tp - pos + pos / 2)) / nullif(max(np * nn), 0) AS auc, max(np) AS np FROM cc GROUP BY 1, 2),
ok AS (SELECT replicate FROM per GROUP BY 1 HAVING count(*) FILTER (auc IS NULL) = 0),
mc AS (SELECT replicate, score AS s, sum(hit) AS pos, sum(1 - hit) AS neg FROM oc2 GROUP BY 1, 2),
mm AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY s DESC) AS tp, sum(pos) OVER (PARTITION BY replicate) AS np, sum(neg) OVER (PARTITION BY replicate) AS nn FROM mc),
mi AS (SELECT replicate, sum(neg * (tp - pos + pos / 2)) / max(np * nn) AS auc_micro FROM mm GROUP BY 1),
ma AS (SELECT replicate, avg(auc) AS auc_macro, sum(auc * np) / sum(np) AS auc_weighted FROM per GROUP BY 1),
k AS (SELECT replicate, class, count(*) FILTER (hit = 1 AND pr = class) AS tp, sum(hit) AS sup, count(*) FILTER (pr = class) AS prd,
        count(*) FILTER (hit = 1 AND score >= 0.5) AS htp, count(*) FILTER (score >= 0.5) AS hprd FROM oc2 GROUP BY 1, 2),
mf AS (SELECT replicate, sum(tp) / sum(sup) AS accuracy, sum(tp) / sum(sup) AS f1_micro, avg(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) END) AS f1_macro,
         avg(CASE WHEN sup + hprd > 0 THEN 2 * htp / (sup + hprd) ELSE 0 END) AS macro_f1 FROM k GROUP BY 1),
m AS (SELECT replicate, auc_micro, auc_macro, auc_weighted, macro_f1, accuracy, f1_macro, f1_micro FROM mi JOIN ma USING (replicate) JOIN mf USING (replicate) JOIN ok USING (replicate)),
u AS (UNPIVOT m ON auc_micro, auc_macro, auc_weighted, macro_f1, accuracy, f1_macro, f1_micro INTO NAME metric VALUE v) {stats_sql('u')}""")
def bootstrap_multiclass(spark, sf):
    d = metrics.as_probabilities(_classes(spark, sf), "probs")
    return _rounded(bootstrap.bootstrap_multiclass(d, "probs", "label", DRAWS, id_col="vec_id"))


@query("choice_accuracy_ci", f"""WITH ch AS (SELECT vec_id, CAST(CASE WHEN embedding[1] > 0 THEN 'A' ELSE 'B' END = CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS INTEGER) AS ok FROM embeddings),
{draw_sql('ch')}, m AS (SELECT replicate, 'accuracy' AS metric, avg(ok) AS v FROM smp GROUP BY replicate) {stats_sql('m')}""")
def choice_accuracy_ci(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("embedding")[0] > 0, "A").otherwise("B").alias("pred"), F.when(F.col("label") < 5, " a").otherwise("B ").alias("ans"))
    return _rounded(bootstrap.choice_accuracy_ci(e, "pred", "ans", DRAWS, id_col="vec_id"))


@query("metric_report", f"""WITH {BIN}, {draw_sql('bin')}, m AS (SELECT replicate, avg((score - y) * (score - y)) AS v FROM smp GROUP BY replicate)
SELECT 'brier' AS metric, printf('%.4f', (SELECT avg((score - y) * (score - y)) FROM bin)) AS value,
       printf('%.4f', avg(v)) || ' ± ' || printf('%.4f', stddev_pop(v)) AS mean_std,
       '[' || printf('%.4f', quantile_cont(v, 0.025)) || ', ' || printf('%.4f', quantile_cont(v, 0.975)) || ']' AS ci FROM m""")
def metric_report(spark, sf):
    b = bootstrap.bootstrap_binary(_binary(spark, sf), "score", "y", DRAWS, id_col="vec_id", names=["brier"])
    return bootstrap.metric_report(b)


# ---- tasks, epochs, statistics, losses -----------------------------------------------------------------------------

@query("task_metrics", f"""WITH {PRED}, {curve_sql('pred', 'score', 'label')},
b AS (SELECT round(sum(neg * (tp - pos + pos / 2)) / max(np * nn), 6) AS auroc, round(sum(pos / np * p), 6) AS auprc, round(max(least(p, r)), 6) AS minpse,
   round(2 * sum(CASE WHEN s > 0.5 THEN pos ELSE 0 END) / (sum(CASE WHEN s > 0.5 THEN pos + neg ELSE 0 END) + max(np)), 6) AS f1,
   round(max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS best_f1,
   round(sum(CASE WHEN s > 0.5 THEN pos ELSE neg END) / max(np + nn), 6) AS accuracy FROM curve),
g AS (SELECT (score - l_linenumber) * 2.0 AS d, l_linenumber * 2.0 + 5 AS y FROM pred),
rg AS (SELECT round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sqrt(avg(d * d)), 6) AS rmse, round(1 - avg(d * d) / var_pop(y), 6) AS r2 FROM g)
SELECT metric, value FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT metric, value FROM (UNPIVOT rg ON COLUMNS(*) INTO NAME metric VALUE value)""")
def task_metrics_query(spark, sf):
    p = predictions(spark, sf).select(
        F.array("score", "score").alias("pred"), F.array(F.col("label").cast("double"), F.col("l_linenumber").cast("double")).alias("label"))
    m = task_metrics(p, "multitask", los_info={"los_mean": 5.0, "los_std": 2.0})
    return m.select("metric", r6("value"))


@query("best_epoch", """
WITH e AS (SELECT o_orderpriority AS run, CAST(month(o_orderdate) AS INTEGER) AS epoch, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT run, arg_max(epoch, value) AS epoch, round(max(value), 4) AS value, arg_min(epoch, value) AS epoch_los FROM e GROUP BY run""")
def best_epoch(spark, sf):
    e = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("epoch")).agg(
        F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("auprc"))
    best = metrics.best_epoch(e, "auprc", "mortality")
    low = metrics.best_epoch(e, "auprc", "los").select("run", F.col("epoch").alias("epoch_los"))
    return best.join(low, "run").select("run", "epoch", F.round("value", 4).alias("value"), "epoch_los")


@query("dataset_stats", f"""WITH {PRED}
SELECT l_linestatus, count(*) AS n_rows, round(min(score), 6) AS min_pred, round(max(score), 6) AS max_pred, round(avg(score), 6) AS mean_pred, max(l_linenumber) + 1 AS n_classes FROM pred GROUP BY 1""")
def dataset_stats(spark, sf):
    s = metrics.dataset_stats(predictions(spark, sf), "l_linestatus", "score", "l_linenumber")
    return s.select("l_linestatus", "n_rows", r6("min_pred"), r6("max_pred"), r6("mean_pred"), "n_classes")


@query("loss_aggregates", f"""WITH {PRED},
a AS (SELECT -avg(label * ln(score) + (1 - label) * ln(1 - score)) AS bce, avg((score - label) * (score - label)) AS mse,
        -avg(label * ln(score) + (1 - label) * ln(1 - score)) + 0.5 * avg((score - l_linenumber) * (score - l_linenumber)) AS multitask,
        sum(CASE WHEN l_linestatus = 'O' THEN CASE WHEN abs(score * 4 - label) < 1 THEN 0.5 * (score * 4 - label) * (score * 4 - label) ELSE abs(score * 4 - label) - 0.5 END ELSE 0 END)
          / (sum(CAST(l_linestatus = 'O' AS INTEGER)) + 1e-6) AS smooth_l1 FROM pred),
{SOFT}, ce AS (SELECT -avg(ln(p[label + 1])) AS v FROM sm)
SELECT 'bce' AS kind, round(bce, 6) AS loss FROM a UNION ALL SELECT 'mse', round(mse, 6) FROM a UNION ALL SELECT 'multitask', round(multitask, 6) FROM a
UNION ALL SELECT 'smooth_l1', round(smooth_l1, 6) FROM a UNION ALL SELECT 'cross_entropy', round(v, 6) FROM ce""")
def loss_aggregates(spark, sf):
    p = predictions(spark, sf).withColumn("m", (F.col("l_linestatus") == "O").cast("int"))
    two = p.select(F.array("score", "score").alias("pred"), F.array(F.col("label").cast("double"), F.col("l_linenumber").cast("double")).alias("label"))
    parts = [
        ("bce", metrics.loss(p, "bce", "score")), ("mse", metrics.loss(p, "mse", "score")),
        ("multitask", metrics.loss(two, "multitask", alpha=(1.0, 0.5))),
        ("smooth_l1", metrics.loss(p.withColumn("s4", F.col("score") * 4), "smooth_l1", "s4", weight="m")),
        ("cross_entropy", metrics.loss(_classes(spark, sf), "cross_entropy", "probs")),
    ]
    out = None
    for kind, df in parts:
        row = df.select(F.lit(kind).alias("kind"), r6("loss"))
        out = row if out is None else out.unionByName(row)
    return out
