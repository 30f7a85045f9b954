"""Bootstrap intervals: a row or cell carries one array of weights for all replicates, never a row for each replicate.

Two exact ways to draw N rows with replacement:

* default: rows are collapsed to distinct metric inputs (cells) with counts, and weights are multinomial draws over cells.
  Cells lie in pieces, pieces are the leaves of a binary tree, and a piece's share of all replicates follows from its path:
  at each node the draws split by one binomial a replicate, whose seed is the node's. So a task needs the sizes of the
  pieces only, and a path also tells what was drawn before the piece, which is the prefix of a scan over sorted scores;
* with ``id_col``: hash draws per row (:func:`splits.resample`), reproducible in SQL, gathered into arrays per row.

Threshold curves sort rows once: pieces are score ranges, and running sums are over arrays of weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.scalars import argmax_index
from ..session import written, written_with
from .metrics import binary_metrics, multiclass_report, ovr_auc, regression_metrics
from .splits import resample

CELLS_PER_PIECE = 2000
MAX_PIECES = 65_536  # sizes of pieces are one small array in every task
CURVE_CELLS = 20_000  # cells of a score range
SAMPLE = 65_536  # scores that place the range ends; they balance work and change no distribution
NUMBERS = 1 << 22  # weights held at once in a task
CURVE = ["area", "ap", "best_f1", "best_f1_eps", "minpse", "hit_tp", "hit_fp", "square"]


def share(ends: np.ndarray, leaf: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws in the leaf, draws in the leaves before it) of each replicate; ``ends``: running sums of leaf sizes from 0."""
    lo, hi = 0, len(ends) - 1
    have, before = np.full(draws, ends[-1], np.int64), np.zeros(draws, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        part, whole = int(ends[mid] - ends[lo]), int(ends[hi] - ends[lo])
        left = np.random.default_rng([seed, lo, hi]).binomial(have, part / whole) if whole else have
        if leaf < mid:
            have, hi = left, mid
        else:
            have, before, lo = have - left, before + left, mid
    return have, before


def spread(rng, counts: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Weights (replicates x cells): ``have`` draws of each replicate over cells of ``counts`` rows, multinomially."""
    cells, rows = len(counts), int(counts.sum())
    if rows > 8 * cells:  # many rows a cell
        return np.stack([rng.multinomial(m, counts / rows) for m in have.tolist()])
    row_cell = np.repeat(np.arange(cells), counts)
    at = np.repeat(np.arange(len(have)), have) * cells + row_cell[rng.integers(0, rows, int(have.sum()))]
    return np.bincount(at, minlength=len(have) * cells).reshape(len(have), cells)


def curve_parts(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, tp0, fp0, n_pos, n_neg, threshold: float) -> np.ndarray:
    """(replicates x CURVE) of one range of scores, sorted down; the four vectors are per replicate: weights above the range
    and in all. Definitions as in :func:`metrics.curve_metrics`."""
    starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    s, pos, neg = score[starts], np.add.reduceat(pos, starts, axis=1), np.add.reduceat(neg, starts, axis=1)
    tp, fp = tp0[:, None] + np.cumsum(pos, axis=1), fp0[:, None] + np.cumsum(neg, axis=1)
    total = np.maximum(n_pos, 1)[:, None]
    precision, recall = tp / np.maximum(tp + fp, 1), np.where(n_pos[:, None] > 0, tp / total, 1.0)
    both, product = precision + recall, 2 * precision * recall
    hit, real = s > threshold, np.isfinite(s)
    t = np.where(real, s, 0.0)
    return np.column_stack([
        (neg * (tp - pos / 2)).sum(axis=1), (pos / total * precision).sum(axis=1), (product / np.where(both > 0, both, 1)).max(axis=1),
        (product / (both + 1e-8)).max(axis=1), np.minimum(precision, recall).max(axis=1), pos[:, hit].sum(axis=1), neg[:, hit].sum(axis=1),
        pos @ (real * (t - 1) ** 2) + neg @ (real * t**2)])


def _curve_totals(parts: DataFrame, by) -> DataFrame:
    """Merge what :func:`curve_parts` gives of the ranges and name the metrics."""
    best = {"best_f1", "best_f1_eps", "minpse"}
    m = parts.groupBy(*by).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), *[(F.max if c in best else F.sum)(c).alias(c) for c in CURVE])
    rows, tp, fp = F.col("n_pos") + F.col("n_neg"), F.col("hit_tp"), F.col("hit_fp")
    return m.select(*by, "n_pos", "n_neg", F.try_divide("area", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"), F.col("ap").alias("auprc"), "minpse",
                    F.coalesce(F.try_divide(tp * 2, tp + fp + F.col("n_pos")), F.lit(0.0)).alias("f1"), "best_f1", "best_f1_eps",
                    F.try_divide(tp + F.col("n_neg") - fp, rows).alias("accuracy"), F.try_divide("square", rows).alias("brier"))


def _placed(rows: DataFrame, score: str, n: int, per_piece: int) -> tuple[DataFrame, int]:
    """``rows`` with ``_piece``, the range of the score; range ends come from the scores of smallest hash, so they depend on
    the data alone. A score without a value is the lowest."""
    pieces = max(1, min(MAX_PIECES, -(-n // per_piece)))
    rows = rows.withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    if pieces == 1:
        return rows.withColumn("_piece", F.lit(0)), 1
    some = np.sort([r[0] for r in rows.select(score).distinct().orderBy(F.xxhash64(score), score).limit(SAMPLE).collect()])
    ends = np.unique(some[np.linspace(0, len(some) - 1, pieces + 1).astype(int)[1:-1]])
    schema = T.StructType([*rows.schema.fields, T.StructField("_piece", T.IntegerType())])
    names = rows.columns
    at = names.index(score)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            piece = np.searchsorted(ends, batch.column(at).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], names=[*names, "_piece"])

    return rows.mapInArrow(run, schema), len(ends) + 1


def binary_replicates(df: DataFrame, score: str, label: str, draws: int, seed: int, threshold: float = 0.5) -> DataFrame:
    """The binary report of each replicate, drawn over cells (score, label) while their sorted ranges are scanned."""
    cells = df.groupBy(F.col(score).cast("double").alias("score"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    cells, seen = written_with(cells, "cells", n=F.count(F.lit(1)))
    placed, pieces = _placed(cells, "score", seen["n"], CURVE_CELLS)
    placed = written(placed, "placed")
    sizes = np.zeros(2 * pieces, np.int64)  # leaves: positives from the highest range down, then negatives
    for r in placed.groupBy("pos", "_piece").agg(F.sum("n").alias("n")).collect():
        sizes[(0 if r["pos"] else pieces) + pieces - 1 - r["_piece"]] = r["n"]
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def scan(pdf):
        pdf = pdf.sort_values(["score", "pos"], ascending=False, kind="stable")
        piece, s, y, n = int(pdf["_piece"].iloc[0]), pdf["score"].to_numpy(), pdf["pos"].to_numpy(), pdf["n"].to_numpy()
        leaves = pieces - 1 - piece, 2 * pieces - 1 - piece
        (have_p, above_p), (have_n, above_n) = (share(ends, leaf, draws, seed) for leaf in leaves)
        n_pos = share(ends, pieces, draws, seed)[1]
        n_neg = int(ends[-1]) - n_pos
        rng, out, step = np.random.default_rng([seed, 2 * pieces, piece]), [], max(1, NUMBERS // len(n))
        for lo in range(0, draws, step):
            at = slice(lo, min(lo + step, draws))
            pos, neg = (np.zeros((at.stop - at.start, len(n)), np.int64) for _ in range(2))
            for w, own, have in ((pos, y, have_p), (neg, ~y, have_n)):
                if own.any():
                    w[:, own] = spread(rng, n[own], have[at])
            out.append(curve_parts(s, pos, neg, above_p[at], above_n[at] - n_pos[at], n_pos[at], n_neg[at], threshold))
        return pd.DataFrame(np.concatenate(out), columns=CURVE).assign(replicate=np.arange(draws), n_pos=n_pos, n_neg=n_neg)

    schema = ", ".join(f"{c} double" for c in CURVE) + ", replicate bigint, n_pos bigint, n_neg bigint"
    return _curve_totals(placed.groupBy("_piece").applyInPandas(scan, schema), ["replicate"])


def weighted_cells(df: DataFrame, cols, draws: int, seed: int) -> DataFrame:
    """(*cols, w): each distinct value with its weights of all replicates, as bytes of 32-bit integers."""
    cols = list(cols)
    cells, seen = written_with(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")), "cells", n=F.count(F.lit(1)))
    pieces = max(1, min(MAX_PIECES, -(-seen["n"] // CELLS_PER_PIECE)))
    cells = cells.withColumn("_order", F.xxhash64(*cols)).withColumn("_piece", F.pmod("_order", F.lit(pieces)).cast("int"))
    sizes = np.zeros(pieces, np.int64)
    for r in cells.groupBy("_piece").agg(F.sum("_n").alias("n")).collect():
        sizes[r["_piece"]] = r["n"]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    schema = T.StructType([*[cells.schema[c] for c in cols], T.StructField("w", T.BinaryType())])

    def draw(pdf):
        pdf = pdf.sort_values("_order", kind="stable").reset_index(drop=True)  # array cells have no pandas order; their hash gives one
        piece, n = int(pdf["_piece"].iloc[0]), pdf["_n"].to_numpy()
        have, rng = share(ends, piece, draws, seed)[0], np.random.default_rng([seed, pieces, piece])
        step = max(1, NUMBERS // len(n))
        w = np.concatenate([spread(rng, n, have[lo:lo + step]) for lo in range(0, draws, step)]).T.astype("<i4")
        return pdf[cols].assign(w=[x.tobytes() for x in w])

    return cells.groupBy("_piece").applyInPandas(draw, schema)


def weighted_rows(df: DataFrame, id_col: str, cols, draws: int, seed: int) -> DataFrame:
    """(*cols, w): each row with its weights by hash draws; rows that no replicate draws are left out."""
    cols = list(cols)
    each = resample(df.select(id_col), id_col, draws, seed).groupBy(id_col).agg(F.collect_list(F.struct("replicate", "weight")).alias("_d"))  # ``draws`` at most
    rows = df.select(id_col, *cols).join(each, id_col).select(*cols, F.col("_d.replicate").alias("_r"), F.col("_d.weight").alias("_w"))
    schema = T.StructType([*[rows.schema[c] for c in cols], T.StructField("w", T.BinaryType())])

    def dense(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r, w in zip(batch.column(len(cols)), batch.column(len(cols) + 1)):
                one = np.zeros(draws, "<i4")
                one[r.values.to_numpy(zero_copy_only=False)] = w.values.to_numpy(zero_copy_only=False)
                out.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cols)], pa.array(out, pa.binary())], names=[*cols, "w"])

    return rows.mapInArrow(dense, schema)


def weighted(df: DataFrame, cols, draws: int, seed: int, id_col: str | None = None) -> DataFrame:
    """A written table (*cols, w)."""
    found = weighted_cells(df, cols, draws, seed) if id_col is None else weighted_rows(df, id_col, cols, draws, seed)
    return written(found, "weights")


def _matrix(w) -> np.ndarray:
    """(rows x replicates) of a column of :func:`weighted`."""
    return np.frombuffer(b"".join(w), "<i4").reshape(len(w), -1).astype(np.int64)


def curve_replicates(rows: DataFrame, draws: int, threshold: float = 0.5) -> DataFrame:
    """The binary report of each (class, replicate) of ``rows(class, score, hit, w)``: ranges of a class are summed, their
    sums run over the ranges above, and each range is scanned once."""
    placed, _ = _placed(rows, "score", rows.count(), CELLS_PER_PIECE)
    placed = written(placed, "placed")
    at = "class int, _piece int, replicate bigint"

    def totals(pdf):
        w, hit = _matrix(pdf["w"]), pdf["hit"].to_numpy() == 1
        return pd.DataFrame({"class": pdf["class"].iloc[0], "_piece": pdf["_piece"].iloc[0], "replicate": np.arange(draws), "p": w[hit].sum(axis=0), "n": w[~hit].sum(axis=0)})

    sums = placed.groupBy("class", "_piece").applyInPandas(totals, f"{at}, p bigint, n bigint")
    per = Window.partitionBy("class", "replicate")  # one row a range
    above = per.orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("class", "_piece", "replicate", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "pn"],
                       *[F.sum(c).over(per).alias(f"{c}_all") for c in "pn"])

    def scan(pdf, before):
        if not len(pdf) or not len(before):
            return pd.DataFrame({c: [] for c in [*CURVE, "class", "replicate", "n_pos", "n_neg"]})
        pdf, before = pdf.sort_values("score", ascending=False, kind="stable"), before.sort_values("replicate")
        w, hit = _matrix(pdf["w"]).T, pdf["hit"].to_numpy() == 1
        tp0, fp0, n_pos, n_neg = (before[c].to_numpy() for c in ("p_above", "n_above", "p_all", "n_all"))
        parts = curve_parts(pdf["score"].to_numpy(), w * hit, w * ~hit, tp0, fp0, n_pos, n_neg, threshold)
        return pd.DataFrame(parts, columns=CURVE).assign(**{"class": pdf["class"].iloc[0]}, replicate=np.arange(draws), n_pos=n_pos, n_neg=n_neg)

    schema = ", ".join(f"{c} double" for c in CURVE) + ", class int, replicate bigint, n_pos bigint, n_neg bigint"
    parts = placed.groupBy("class", "_piece").cogroup(sums.groupBy("class", "_piece")).applyInPandas(scan, schema)
    return _curve_totals(parts, ["class", "replicate"])


def weighted_sums(rows: DataFrame, features: dict, draws: int) -> DataFrame:
    """(replicate, *names): sums of the feature columns times the weights ``w``, by one product a batch."""
    names = list(features)

    def run(batches):
        total = np.zeros((draws, len(names)))
        for pdf in batches:
            if len(pdf):
                total += _matrix(pdf["w"]).T @ pdf[names].to_numpy(dtype=float, na_value=0.0)
        yield pd.DataFrame(total, columns=names).assign(replicate=np.arange(draws))

    flat = rows.select("w", *[c.cast("double").alias(k) for k, c in features.items()])
    parts = flat.mapInPandas(run, ", ".join(f"{c} double" for c in names) + ", replicate bigint")
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])


def summary(values: DataFrame, point: DataFrame, names, level: float) -> DataFrame:
    """Long table ``(metric, value, mean, std, median, ci_lower, ci_upper, n_bootstrap)``.

    Replicates whose value is null or NaN are left out.
    """
    tail = (1 - level) / 2

    def long(df, out):
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names]))
        return df.select(pairs.alias("p")).select("p.metric", F.nanvl(F.col("p.v"), F.lit(None)).alias(out))

    stats = long(values, "v").groupBy("metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.percentile("v", 0.5).alias("median"), F.percentile("v", tail).alias("ci_lower"),
        F.percentile("v", 1 - tail).alias("ci_upper"), F.count("v").alias("n_bootstrap"))
    # Both sides have one row per metric name.
    return long(point, "value").join(F.broadcast(stats), "metric", "left").withColumn(
        "n_bootstrap", F.coalesce("n_bootstrap", F.lit(0).cast("bigint")))


BINARY = ["auroc", "auprc", "minpse", "f1", "best_f1", "best_f1_eps", "accuracy", "brier"]
REGRESSION = ["mae", "mse", "rmse", "r2"]
MULTICLASS = ["auc_micro", "auc_macro", "auc_weighted", "macro_f1", "accuracy", "f1_macro", "f1_micro"]


def bootstrap_binary(df, score, label, draws: int = 1000, level: float = 0.95, seed: int = 42,
                     id_col: str | None = None, names=tuple(BINARY)) -> DataFrame:
    """Intervals of the binary report; replicates with one class only are skipped."""
    if id_col is None:
        per = binary_replicates(df, score, label, draws, seed)
    else:
        rows = weighted(df, [score, label], draws, seed, id_col)
        per = curve_replicates(rows.select(F.lit(0).alias("class"), F.col(score).alias("score"), (F.col(label) == 1).cast("int").alias("hit"), "w"), draws)
    per = per.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return summary(per, binary_metrics(df, score, label), names, level)


def bootstrap_regression(df, pred, label, draws: int = 1000, level: float = 0.95, seed: int = 42,
                         id_col: str | None = None) -> DataFrame:
    """Intervals of MAE, MSE, RMSE and R squared."""
    # All four metrics ignore a common shift; centring keeps the weighted second moments exact.
    centre = df.agg(F.avg(label).alias("m")).first()["m"] or 0.0
    flat = df.withColumn(pred, F.col(pred) - F.lit(centre)).withColumn(label, F.col(label) - F.lit(centre))
    gap, y = F.col(pred) - F.col(label), F.col(label)
    sums = weighted_sums(weighted(flat, [pred, label], draws, seed, id_col), {
        "n": F.lit(1), "a": F.abs(gap), "q": gap * gap, "y": y, "yy": y * y}, draws)
    mse, mean = F.try_divide("q", "n"), F.try_divide("y", "n")
    per = sums.select("replicate", F.try_divide("a", "n").alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                      (F.lit(1.0) - F.try_divide(mse, F.try_divide("yy", "n") - mean * mean)).alias("r2"))
    return summary(per, regression_metrics(df, pred, label), REGRESSION, level)


def multiclass_wide(df, probs, label, by=(), weight=None, edges=None) -> DataFrame:
    """AUC means and the class report in one row per group."""
    # A class without both kinds of rows has no AUC, and then neither macro nor weighted is defined.
    auc = ovr_auc(df, probs, label, by, weight, edges, one_class=None)
    scopes = [F.max(F.when(F.col("scope") == s, F.col("auc"))).alias(f"auc_{s}") for s in ("micro", "macro", "weighted")]
    wide = auc.groupBy(*by).agg(*scopes)
    rep = multiclass_report(df, probs, label, by, weight).withColumnRenamed("f1_macro_half", "macro_f1")
    both = wide.unionByName(rep, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in MULTICLASS])


def multiclass_replicates(rows: DataFrame, probs: str, label: str, draws: int, n_classes: int) -> DataFrame:
    """The multiclass report of each replicate of ``rows(probs, label, w)``; replicates lacking a class are left out."""
    each = rows.select("w", F.col(label).alias("_y"), F.posexplode(probs).alias("class", "score"))
    each = each.select(F.explode(F.array("class", F.lit(-1))).alias("class"), "score", (F.col("class") == F.col("_y")).cast("int").alias("hit"), "w")
    auc = curve_replicates(each, draws)  # class -1 pools all classes
    own, n_pos = F.col("class") >= 0, F.when(F.col("class") >= 0, F.col("n_pos"))
    means = auc.groupBy("replicate").agg(
        F.max(F.when(~own, F.col("auroc"))).alias("auc_micro"), F.avg(F.when(own, F.col("auroc"))).alias("auc_macro"),
        (F.sum(F.when(own, F.col("auroc") * F.col("n_pos"))) / F.sum(n_pos)).alias("auc_weighted"), F.count_if(own & F.col("auroc").isNull()).alias("lacking"))
    hard, y, p = argmax_index(F.col(probs)), F.col(label), F.col(probs)
    kinds = {"tp": lambda c: (hard == c) & (y == c), "sup": lambda c: y == c, "prd": lambda c: hard == c,
             "htp": lambda c: (p[c] >= 0.5) & (y == c), "hprd": lambda c: p[c] >= 0.5}
    sums = weighted_sums(rows, {f"{k}{c}": f(c).cast("int") for k, f in kinds.items() for c in range(n_classes)}, draws)

    def total(kind):
        return sum((F.col(f"{kind}{c}") for c in range(n_classes)), F.lit(0.0))

    def f1(tp, prd, c):
        return F.try_divide(F.col(f"{tp}{c}") * 2, F.col(f"sup{c}") + F.col(f"{prd}{c}"))

    seen = [f1("tp", "prd", c) for c in range(n_classes)]  # null where a class is neither label nor prediction
    there = sum((x.isNotNull().cast("int") for x in seen), F.lit(0))
    report = sums.select("replicate", F.try_divide(total("tp"), total("sup")).alias("accuracy"), F.try_divide(total("tp"), total("sup")).alias("f1_micro"),
                         F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in seen), F.lit(0.0)), there).alias("f1_macro"),
                         (sum((F.coalesce(f1("htp", "hprd", c), F.lit(0.0)) for c in range(n_classes)), F.lit(0.0)) / n_classes).alias("macro_f1"))
    return means.where("lacking = 0").join(report, "replicate").select("replicate", *MULTICLASS)


def bootstrap_multiclass(df, probs, label, draws: int = 1000, level: float = 0.95, seed: int = 42,
                         id_col: str | None = None) -> DataFrame:
    """Intervals of the one-vs-rest AUC means and the class report; replicates lacking a class are skipped."""
    flat = df.select(*([id_col] if id_col else []), F.col(probs).cast("array<double>").alias(probs), label)
    n_classes = flat.agg(F.max(F.size(probs)).alias("k")).first()["k"] or 1
    per = multiclass_replicates(weighted(flat, [probs, label], draws, seed, id_col), probs, label, draws, n_classes)
    return summary(per, multiclass_wide(flat, probs, label), MULTICLASS, level)


def choice_accuracy_ci(df, pred, label, draws: int = 1000, level: float = 0.95, seed: int = 42,
                       id_col: str | None = None) -> DataFrame:
    """Interval of the share of right answers."""
    right = df.withColumn("_right", (F.col(pred) == F.upper(F.trim(F.col(label)))).cast("int"))
    sums = weighted_sums(weighted(right, ["_right"], draws, seed, id_col), {"n": F.lit(1), "r": F.col("_right")}, draws)
    return summary(sums.select("replicate", F.try_divide("r", "n").alias("accuracy")), right.agg(F.avg("_right").alias("accuracy")), ["accuracy"], level)


def metric_report(stats: DataFrame, digits: int = 4) -> DataFrame:
    """Text form of a summary: ``(metric, value, mean_std, ci)``; missing numbers print as NaN."""
    def text(c):
        return F.when(F.col(c).isNull() | F.isnan(c), "NaN").otherwise(F.format_string(f"%.{digits}f", F.col(c)))

    return stats.select("metric", text("value").alias("value"),
                        F.concat_ws(" ± ", text("mean"), text("std")).alias("mean_std"),
                        F.concat(F.lit("["), text("ci_lower"), F.lit(", "), text("ci_upper"), F.lit("]")).alias("ci"))
