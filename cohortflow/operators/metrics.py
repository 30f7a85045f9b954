"""Evaluation metrics as grouped aggregates.

Every function takes optional grouping columns ``by`` and an optional row ``weight`` (bootstrap counts), so
one implementation serves single tables, groups and replicates.

Threshold curves work on the distinct scores of a group. The scores are cut into ranges by sampled
quantiles; cumulative counts run inside a range and are shifted by the small table of range totals. A group
that holds most of the rows is thereby spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import last_step  # noqa: F401  (re-exported for sequence predictions)
from ..functions.scalars import argmax_index, array_sum, softmax
from .ordering import range_edges, range_piece


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def _ratio(a: Column, b: Column) -> Column:
    """a/b with 0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return _ratio(p * r * 2, p + r)


def confusion_at(df: DataFrame, score: str, label: str, threshold: float = 0.5, strict: bool = False, by=(),
                 weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp, accuracy, precision, recall, f1 with prediction ``score >= t`` (``> t`` if strict)."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    pos = F.col(label) == 1
    w = _w(weight)

    def total(cond):
        return F.sum(F.when(cond, w).otherwise(0)).cast("bigint")

    counts = df.groupBy(*by).agg(total(~hit & ~pos).alias("tn"), total(hit & ~pos).alias("fp"),
                                 total(~hit & pos).alias("fn"), total(hit & pos).alias("tp"))
    return _with_rates(counts)


def _with_rates(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (counts.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", _ratio(tp, tp + fp))
            .withColumn("recall", _ratio(tp, tp + fn))
            .withColumn("f1", _ratio(tp * 2, tp * 2 + fp + fn)))


def threshold_counts(df: DataFrame, score: str, label: str, by=(), weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: ``(by, score, pos, neg)``."""
    w = _w(weight).cast("bigint")
    pos = F.col(label) == 1
    return (df.groupBy(*by, F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.when(pos, w).otherwise(0)).alias("pos"), F.sum(F.when(pos, 0).otherwise(w)).alias("neg")))


def threshold_curve(df: DataFrame, score: str, label: str, by=(), weight: str | None = None, edges=None) -> DataFrame:
    """Per distinct score: counts at it (``pos``, ``neg``), at or above it (``tp``, ``fp``) and in total."""
    by = list(by)
    if edges is None:
        edges = range_edges(df, score)
    counts = threshold_counts(df, score, label, by, weight).withColumn("_piece", range_piece(F.col("score"), edges))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    above = group.orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    everything = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = (counts.groupBy(*by, "_piece").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
              .select(*by, "_piece",
                      F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p_above"),
                      F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n_above"),
                      F.sum("_p").over(everything).alias("n_pos"), F.sum("_n").over(everything).alias("n_neg")))
    if not by:
        pieces = F.broadcast(pieces)  # one row per score range
    run = Window.partitionBy(*by, "_piece").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("_tp", F.sum("pos").over(run)).withColumn("_fp", F.sum("neg").over(run))
            .join(pieces, [*by, "_piece"])
            .select(*by, "score", "pos", "neg", (F.col("_tp") + F.col("_p_above")).alias("tp"),
                    (F.col("_fp") + F.col("_n_above")).alias("fp"), "n_pos", "n_neg"))


def curve_metrics(curve: DataFrame, by=(), recall_at: float = 0.9, threshold: float = 0.5) -> DataFrame:
    """All metrics of a curve in one aggregation; unused ones are pruned by the optimizer."""
    s, tp, fp, pos, neg = (F.col(c) for c in ("score", "tp", "fp", "pos", "neg"))
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    # Without positives recall counts as 1 at every threshold.
    precision, recall = _ratio(tp, tp + fp), F.when(n_pos == 0, 1.0).otherwise(_ratio(tp, n_pos))
    tp0, fp0 = tp - pos, fp - neg
    precision0 = F.when(tp0 + fp0 == 0, 1.0).otherwise(_ratio(tp0, tp0 + fp0))
    f1 = f1_of(precision, recall)
    f1_eps = precision * recall * 2 / (precision + recall + F.lit(1e-8))
    area = F.sum(neg.cast("double") * (tp0.cast("double") + pos / F.lit(2.0)))
    at = F.when(recall >= recall_at, F.struct(s.alias("threshold"), tp.alias("tp"), fp.alias("fp")))
    best = F.max(F.struct(f1_eps.alias("f1"), (-s).alias("neg")))
    hit = s > threshold
    p_total, n_total = F.max(n_pos), F.max(n_neg)
    hit_tp, hit_fp = F.sum(F.when(hit, pos).otherwise(0)), F.sum(F.when(hit, neg).otherwise(0))
    return curve.groupBy(*by).agg(
        p_total.alias("n_pos"), n_total.alias("n_neg"),
        F.try_divide(area, p_total.cast("double") * n_total).alias("roc_auc"),
        F.sum(_ratio(pos, n_pos) * precision).alias("average_precision"),
        F.sum(_ratio(pos, n_pos) * (precision + precision0) / 2).alias("pr_auc"),
        best.alias("_best"), F.max(f1).alias("best_f1_plain"), F.max(F.least(precision, recall)).alias("min_pse"),
        F.max(at).alias("_at"),
        _ratio(hit_tp * 2, hit_tp + hit_fp + p_total).alias("f1_at"),
        _ratio(hit_tp + n_total - hit_fp, p_total + n_total).alias("accuracy_at"),
        # A score's squared error depends on its counts only.
        (F.sum(pos * (s - 1) * (s - 1) + neg * s * s) / (p_total + n_total)).alias("brier"),
    )


def roc_auc(df, score, label, by=(), weight=None, edges=None, one_class: float | None = 0.0) -> DataFrame:
    """Area under the ROC curve, ties counted half; ``one_class`` is the value when a class is absent."""
    m = curve_metrics(threshold_curve(df, score, label, by, weight, edges), by)
    fallback = F.lit(one_class).cast("double") if one_class is not None else F.raise_error(
        F.lit("ROC AUC needs both classes"))
    return m.select(*by, F.coalesce("roc_auc", fallback).alias("roc_auc"))


def average_precision(df, score, label, by=(), weight=None, edges=None) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    return curve_metrics(threshold_curve(df, score, label, by, weight, edges), by).select(*by, "average_precision")


def pr_auc_trapezoid(df, score, label, by=(), weight=None, edges=None) -> DataFrame:
    """Trapezoid area under the precision-recall curve with end point (recall 0, precision 1)."""
    return curve_metrics(threshold_curve(df, score, label, by, weight, edges), by).select(*by, "pr_auc")


def best_f1(df, score, label, by=(), weight=None, edges=None, zero_safe: bool = False) -> DataFrame:
    """Best F1 over all thresholds and the lowest threshold that reaches it.

    The default form divides by p + r + 1e-8; ``zero_safe`` divides exactly and gives 0 on 0/0.
    """
    m = curve_metrics(threshold_curve(df, score, label, by, weight, edges), by)
    value = F.col("best_f1_plain") if zero_safe else F.col("_best.f1")
    # With no gain at any score the end point (recall 0) ties and the first point of the list wins.
    return m.select(*by, value.alias("f1"), (-F.col("_best.neg")).alias("threshold"))


def min_pse(df, score, label, by=(), weight=None, edges=None) -> DataFrame:
    """Largest min(precision, recall) over all thresholds."""
    return curve_metrics(threshold_curve(df, score, label, by, weight, edges), by).select(*by, "min_pse")


def recall_point(df, score, label, r: float = 0.9, by=(), weight=None, edges=None) -> DataFrame:
    """Highest threshold whose recall is at least ``r``, with the confusion counts there."""
    m = curve_metrics(threshold_curve(df, score, label, by, weight, edges), by, r)
    counts = m.select(*by, F.col("_at.threshold").alias("threshold"),
                      (F.col("n_neg") - F.col("_at.fp")).alias("tn"), F.col("_at.fp").alias("fp"),
                      (F.col("n_pos") - F.col("_at.tp")).alias("fn"), F.col("_at.tp").alias("tp"))
    return _with_rates(counts)


def brier(df, score, label, by=(), weight=None) -> DataFrame:
    """Mean squared distance of score and label."""
    w = _w(weight)
    gap = F.col(score) - F.col(label)
    return df.groupBy(*by).agg((F.sum(gap * gap * w) / F.sum(w)).alias("brier"))


def binary_metrics(df, score, label, by=(), weight=None, edges=None, threshold: float = 0.5) -> DataFrame:
    """The usual binary report in one pass over the distinct scores.

    ``f1`` and ``accuracy`` use strict ``score > threshold``; ``best_f1`` is the zero-safe form, ``best_f1_eps``
    the one with 1e-8 in the denominator, which also defines ``threshold``.
    """
    m = curve_metrics(threshold_curve(df, score, label, by, weight, edges), by, threshold=threshold)
    return m.select(
        *by, F.coalesce("roc_auc", F.lit(0.0)).alias("auroc"), F.col("average_precision").alias("auprc"),
        F.col("min_pse").alias("minpse"), F.col("f1_at").alias("f1"), F.col("best_f1_plain").alias("best_f1"),
        F.col("accuracy_at").alias("accuracy"), "brier", F.col("_best.f1").alias("best_f1_eps"),
        (-F.col("_best.neg")).alias("threshold"), "n_pos", "n_neg")


def inverted(df: DataFrame, score: str, label: str) -> DataFrame:
    """Score and label of the opposite class."""
    return df.withColumn(score, F.lit(1) - F.col(score)).withColumn(label, F.lit(1) - F.col(label))


def as_probabilities(df: DataFrame, probs: str, tolerance: float = 0.01, check_range: bool = True) -> DataFrame:
    """Apply softmax to a vector column unless the whole column already holds probabilities.

    The decision is about the table: rows must sum to one within the tolerance and, if checked, lie in [0, 1].
    """
    ok = F.abs(array_sum(F.col(probs)) - 1.0) <= F.lit(tolerance)
    if check_range:
        ok = ok & (F.array_min(F.col(probs)) >= 0) & (F.array_max(F.col(probs)) <= 1)
    normalised = df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok")).first()["ok"]
    return df if normalised else df.withColumn(probs, softmax(F.col(probs)))


def class_rows(df: DataFrame, probs: str, label: str, by=(), weight=None) -> DataFrame:
    """One row per (row, class): ``class``, ``score``, ``hit``."""
    extra = [weight] if weight else []
    return (df.select(*by, *extra, F.col(label).alias("_y"), F.posexplode(F.col(probs)).alias("class", "score"))
            .withColumn("hit", (F.col("class") == F.col("_y")).cast("int")).drop("_y"))


def ovr_auc(df, probs, label, by=(), weight=None, edges=None, one_class: float | None = 0.0) -> DataFrame:
    """One-vs-rest AUC: per class, and ``micro``, ``macro``, ``weighted`` rows in column ``scope``.

    ``one_class`` is the value of a class that has no positives or no negatives; with ``None`` such a class,
    and then macro and weighted too, are null.
    """
    rows = class_rows(df, probs, label, by, weight)
    if edges is None:
        edges = range_edges(rows, "score")
    # Class -1 pools all classes, so per-class and micro curves come from one pass.
    pooled = rows.withColumn("class", F.explode(F.array(F.col("class"), F.lit(-1))))
    per = curve_metrics(threshold_curve(pooled, "score", "hit", [*by, "class"], weight, edges), [*by, "class"])
    own = F.col("class") >= 0
    auc = F.coalesce("roc_auc", F.lit(one_class).cast("double"))
    whole = F.count_if(own & auc.isNull()) == 0
    n_pos = F.when(own, F.col("n_pos"))
    tables = per.groupBy(*by).agg(
        F.collect_list(F.struct(F.when(own, F.concat(F.lit("class_"), F.col("class").cast("string"))).otherwise("micro")
                                .alias("scope"), auc.alias("auc"))).alias("_each"),  # one entry per class
        F.when(whole, F.avg(F.when(own, auc))).alias("_macro"),
        F.when(whole, F.sum(auc * n_pos) / F.sum(n_pos)).alias("_weighted"))
    means = F.array(F.struct(F.lit("macro").alias("scope"), F.col("_macro").alias("auc")),
                    F.struct(F.lit("weighted").alias("scope"), F.col("_weighted").alias("auc")))
    return tables.select(*by, F.inline(F.concat("_each", means)))


def confusion_matrix(df, pred, label, by=(), weight=None) -> DataFrame:
    """Row counts per (label, prediction)."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.sum(_w(weight)).cast("bigint").alias("n"))


def class_report(df, pred, label, by=(), weight=None) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs as label or prediction (0 on empty)."""
    m = confusion_matrix(df, pred, label, by, weight)
    sides = m.select(*by, "n", F.explode(F.array(
        F.struct(F.col("label").cast("int").alias("class"), F.lit(1).alias("is_label"),
                 (F.col("label") == F.col("pred")).cast("int").alias("right")),
        F.struct(F.col("pred").cast("int").alias("class"), F.lit(0).alias("is_label"), F.lit(0).alias("right")),
    )).alias("s"))
    n = F.col("n")
    agg = sides.groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.is_label") == 1, n).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_label") == 0, n).otherwise(0)).alias("predicted"),
        F.sum(n * F.col("s.right")).alias("tp"))
    return agg.select(*by, "class", "support", "predicted", "tp",
                      _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                      _ratio(F.col("tp"), F.col("support")).alias("recall"),
                      _ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")).alias("f1"))


def multiclass_report(df, probs, label, by=(), weight=None) -> DataFrame:
    """Accuracy by argmax, macro and micro F1, and macro F1 of the ``probability >= 0.5`` predictions."""
    hard = df.withColumn("_pred", argmax_index(F.col(probs)))
    per = class_report(hard, "_pred", label, by, weight)
    acc = _ratio(F.sum("tp"), F.sum("support"))
    top = per.groupBy(*by).agg(acc.alias("accuracy"), F.avg("f1").alias("f1_macro"), acc.alias("f1_micro"))
    soft = confusion_at(class_rows(df, probs, label, by, weight), "score", "hit", 0.5, by=[*by, "class"], weight=weight)
    half = soft.groupBy(*by).agg(F.avg("f1").alias("f1_macro_half"))
    names = ["accuracy", "f1_macro", "f1_micro", "f1_macro_half"]
    both = top.unionByName(half, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in names])


def regression_metrics(df, pred, label, by=(), weight=None) -> DataFrame:
    """MAE, MSE, RMSE and R squared."""
    w = _w(weight)
    gap = F.col(pred) - F.col(label)
    base = df.groupBy(*by).agg(
        F.sum(w).alias("_n"), F.sum(F.abs(gap) * w).alias("_abs"), F.sum(gap * gap * w).alias("_sq"),
        # Central moments merge stably; with weights the mean is folded in by the two plain sums.
        *( [F.var_pop(F.col(label).cast("double")).alias("_var")] if weight is None else
           [(F.sum(F.col(label) * F.col(label) * w) / F.sum(w)
             - F.pow(F.sum(F.col(label) * w) / F.sum(w), F.lit(2))).alias("_var")]))
    mse = F.col("_sq") / F.col("_n")
    return base.select(*by, (F.col("_abs") / F.col("_n")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                       (F.lit(1.0) - F.try_divide(mse, F.col("_var"))).alias("r2"))


def label_histogram(df, label, n_classes: int, by=()) -> DataFrame:
    """Rows per class 0..n-1, zero-filled."""
    counts = df.groupBy(*by, F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    packed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("class", "_n"))).alias("_m"))
    return packed.select(*by, "_m", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class")).select(
        *by, "class", F.coalesce(F.try_element_at("_m", F.col("class")), F.lit(0).cast("bigint")).alias("n"))


def best_epoch(df, metric: str, task: str, by=("run",)) -> DataFrame:
    """First epoch with the best value: smallest for length of stay, largest otherwise.

    ``df(run, epoch, metric, value)``.
    """
    sign = -1 if task == "los" else 1
    best = F.max(F.struct((F.col("value") * sign).alias("v"), (-F.col("epoch")).alias("e")))
    return (df.filter(F.col("metric") == metric).groupBy(*by).agg(best.alias("_b"))
            .select(*by, (-F.col("_b.e")).alias("epoch"), (F.col("_b.v") * sign).alias("value")))


def dataset_stats(df, split: str, pred: str | None = None, label: str | None = None) -> DataFrame:
    """Rows per split, min/max/mean prediction, and number of classes (largest label + 1)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if pred:
        aggs += [F.min(pred).alias("min_pred"), F.max(pred).alias("max_pred"), F.avg(pred).alias("mean_pred")]
    if label:
        aggs += [(F.max(F.col(label).cast("int")) + 1).alias("n_classes")]
    return df.groupBy(split).agg(*aggs)


def valid_choices(df, pred: str) -> DataFrame:
    """Rows with a parsed answer."""
    return df.filter(F.col(pred).isNotNull())


def choice_validity(df, pred: str, label: str, by=()) -> DataFrame:
    """Valid and dropped answers and the accuracy over valid ones; no valid answer at all is an error."""
    agg = df.groupBy(*by).agg(
        F.count(pred).alias("n_valid"), F.count_if(F.col(pred).isNull()).alias("n_dropped"),
        F.sum((F.col(pred) == F.upper(F.trim(F.col(label)))).cast("int")).alias("_right"))
    acc = F.when(F.col("n_valid") == 0, F.raise_error(F.lit("no valid predictions found"))).otherwise(
        F.col("_right") / F.col("n_valid"))
    return agg.select(*by, "n_valid", "n_dropped", acc.alias("accuracy"))


def loss(df, kind: str, pred: str = "pred", label: str = "label", by=(), weight: str | None = None,
         alpha=(1.0, 1.0), beta: float = 1.0) -> DataFrame:
    """Loss over a prediction table.

    ``bce`` and ``mse`` are means; ``multitask`` takes two-entry vectors and adds alpha0*bce + alpha1*mse;
    ``cross_entropy`` takes logits and a class index; ``smooth_l1`` takes a 0/1 ``weight`` column as mask and
    divides by the mask sum + 1e-6. Logarithms are bounded below by -100.
    """
    p, y = F.col(pred), F.col(label)

    def bce(p, y):
        def safe(v):
            return F.when(v <= 0, F.lit(-100.0)).otherwise(F.greatest(F.ln(v), F.lit(-100.0)))
        return -(y * safe(p) + (F.lit(1) - y) * safe(F.lit(1) - p))

    if kind == "bce":
        value = F.avg(bce(p, y))
    elif kind == "mse":
        value = F.avg((p - y) * (p - y))
    elif kind == "multitask":
        p0, p1, y0, y1 = F.element_at(p, 1), F.element_at(p, 2), F.element_at(y, 1), F.element_at(y, 2)
        value = F.lit(alpha[0]) * F.avg(bce(p0, y0)) + F.lit(alpha[1]) * F.avg((p1 - y1) * (p1 - y1))
    elif kind == "cross_entropy":
        top = F.array_max(p)
        norm = F.ln(array_sum(F.transform(p, lambda v: F.exp(v - top)))) + top
        value = F.avg(norm - F.element_at(p, y.cast("int") + 1))
    elif kind == "smooth_l1":
        gap = F.abs(p - y)
        cell = F.when(gap < beta, gap * gap * 0.5 / F.lit(beta)).otherwise(gap - F.lit(0.5 * beta))
        m = _w(weight)
        value = F.sum(cell * m) / (F.sum(m) + F.lit(1e-6))
    else:
        raise ValueError(f"unknown loss {kind}")
    return df.groupBy(*by).agg(value.alias("loss"))
