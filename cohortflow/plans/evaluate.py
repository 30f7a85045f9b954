"""Which metrics belong to which task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.answers import option_vector, parse_letter_az, parse_probability
from ..functions.scalars import reverse_los, task_label
from ..operators import bootstrap as bs
from ..operators import metrics as m

BINARY_TASKS = ("mortality", "readmission")


def task_metrics(df: DataFrame, task: str, pred: str = "pred", label: str = "label", los_info: dict | None = None,
                 bootstrap: bool = False, draws: int = 1000, level: float = 0.95, seed: int = 42,
                 id_col: str | None = None) -> DataFrame:
    """Long metric table of a prediction table.

    mortality, readmission: binary; los: regression on de-standardised values; multiclass: vector of class
    probabilities (or logits); multitask: two-entry vectors, binary on the first entry and regression on the
    second. A label vector is reduced to the entry of the task.
    """
    info = {"mean": (los_info or {}).get("los_mean", 0.0), "std": (los_info or {}).get("los_std", 1.0)}
    boot = dict(draws=draws, level=level, seed=seed, id_col=id_col)
    if df.schema[label].dataType.typeName() == "array" and task in (*BINARY_TASKS, "los"):
        df = df.withColumn(label, task_label(F.col(label), task))
    if task in BINARY_TASKS:
        if bootstrap:
            return bs.bootstrap_binary(df, pred, label, **boot)
        return _long(m.binary_metrics(df, pred, label), ["auroc", "auprc", "minpse", "f1", "best_f1", "accuracy"])
    if task == "los":
        df = df.withColumn(pred, reverse_los(F.col(pred), **info)).withColumn(label, reverse_los(F.col(label), **info))
        if bootstrap:
            return bs.bootstrap_regression(df, pred, label, **boot)
        return _long(m.regression_metrics(df, pred, label), bs.REGRESSION)
    if task == "multiclass":
        df = m.as_probabilities(df, pred, 1e-5, check_range=False)
        if bootstrap:
            return bs.bootstrap_multiclass(df, pred, label, **boot)
        # A class without both kinds of rows makes the AUC means 0 here.
        return _long(bs.multiclass_wide(df, pred, label), bs.MULTICLASS).withColumn("value", F.coalesce("value", F.lit(0.0)))
    if task == "multitask":
        keep = [id_col] if id_col else []
        first = df.select(*keep, F.element_at(pred, 1).alias(pred), F.element_at(label, 1).alias(label))
        second = df.select(*keep, F.element_at(pred, 2).alias(pred), F.element_at(label, 2).alias(label))
        return task_metrics(first, "mortality", pred, label, None, bootstrap, **boot).unionByName(
            task_metrics(second, "los", pred, label, los_info, bootstrap, **boot))
    raise ValueError("Task not supported")


def response_metrics(df: DataFrame, task: str, response: str = "response", label: str = "label", recall: float = 0.9) -> DataFrame:
    """From answer texts to a report: ``(report, metric, value)``.

    mortality, readmission: the probability read from each text (-1 where none is found, which stays in, as a sure no),
    judged plainly (``plain``), as the opposite class (``inverted``) and there at the highest threshold with the asked
    recall (``recall_point``). los: ``response`` is a map from option letter to probability. exam: option letters,
    unread answers dropped. ``answers`` counts texts and what could not be read.
    """
    if task in BINARY_TASKS:
        read = df.select("*", parse_probability(F.col(response)).alias("_p"))
        lost, flipped = F.count_if(F.col("_p") < 0), m.inverted(read, "_p", label)
        reports = {"plain": m.binary_metrics(read, "_p", label), "inverted": m.binary_metrics(flipped, "_p", label)}
        long = [_long(wide, ["auroc", "auprc", "minpse", "f1", "best_f1", "accuracy", "brier"]).withColumn("report", F.lit(name)) for name, wide in reports.items()]
        point = m.recall_point(flipped, "_p", label, recall)
        long.append(_long(point, ["threshold", "tn", "fp", "fn", "tp", "precision", "recall"]).withColumn("report", F.lit("recall_point")))
    elif task == "los":
        read = df.select("*", option_vector(F.col(response), ["A", "B", "C", "D"]).alias("_p"))
        lost = F.count_if(F.col(response).isNull())
        long = [task_metrics(read, "multiclass", "_p", label).withColumn("report", F.lit("plain"))]
    elif task == "exam":
        read = df.select("*", parse_letter_az(F.col(response)).alias("_p"))
        lost = F.count_if(F.col("_p").isNull())
        long = [_long(m.choice_validity(read, "_p", label), ["accuracy"]).withColumn("report", F.lit("plain"))]
    else:
        raise ValueError("Task not supported")
    long.append(_long(read.agg(F.count(F.lit(1)).alias("n"), lost.alias("unread")), ["n", "unread"]).withColumn("report", F.lit("answers")))
    out = long[0]
    for part in long[1:]:
        out = out.unionByName(part)
    return out.select("report", "metric", "value")


def _long(wide: DataFrame, names) -> DataFrame:
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                                           for n in names])).alias("p")).select("p.*")
