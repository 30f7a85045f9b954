import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import bootstrap, metrics
from cohortflow.plans.evaluate import task_metrics

SCORES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
LABELS = [0, 0, 1, 0, 0, 1, 1, 0, 1]


def table(spark, scores, labels):
    return spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "score double, label int")


def auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None, :]).mean() + (p[:, None] == n[None, :]).mean() / 2) if len(p) and len(n) else float("nan")


def curve(s, y):
    t = np.unique(s)
    tp = np.array([((s >= v) & (y == 1)).sum() for v in t])
    fp = np.array([((s >= v) & (y == 0)).sum() for v in t])
    return t, tp / (tp + fp), tp / y.sum()


def ap(s, y):
    _, p, r = curve(s, y)
    return float(np.sum(np.diff(np.concatenate([[0], r[::-1]])) * p[::-1]))


def test_golden_rows(spark):
    df = table(spark, SCORES, LABELS)
    m = metrics.binary_metrics(df, "score", "label").first()
    assert m["auroc"] == pytest.approx(0.75) and m["auprc"] == pytest.approx(0.747024, abs=1e-6)
    assert m["brier"] == pytest.approx(0.205556, abs=1e-6) and m["minpse"] == pytest.approx(0.75)
    assert metrics.pr_auc_trapezoid(df, "score", "label").first()["pr_auc"] == pytest.approx(0.706845, abs=1e-6)
    best = metrics.best_f1(df, "score", "label").first()
    assert best["f1"] == pytest.approx(0.75, abs=1e-6) and best["threshold"] == 0.6
    point = metrics.recall_point(df, "score", "label").first()
    assert point["threshold"] == 0.3 and (point["tp"], point["fp"], point["fn"], point["tn"]) == (4, 3, 0, 2)
    loose, strict = (metrics.confusion_at(df, "score", "label", 0.5, s).first() for s in (False, True))
    assert (loose["tp"], loose["fp"]) == (3, 2) and (strict["tp"], strict["fp"]) == (3, 1)


def test_one_class(spark):
    df = table(spark, [0.2, 0.4], [1, 1])
    assert metrics.roc_auc(df, "score", "label").first()["roc_auc"] == 0.0
    with pytest.raises(Exception, match="both classes"):
        metrics.roc_auc(df, "score", "label", one_class=None).collect()


@pytest.mark.parametrize("ties", [10, 100000])
def test_against_numpy_for_any_partitioning(spark, partitions, ties):
    rng = np.random.default_rng(ties)
    s = np.round(rng.beta(0.2, 2, 3000) * ties) / ties  # crowded near zero
    y = (rng.random(3000) < 0.2 + s / 2).astype(int)
    _, p, r = curve(s, y)
    want = (auc(s, y), ap(s, y), np.minimum(p, r).max())
    for n in (1, 4, 64):
        partitions(n)
        m = metrics.binary_metrics(table(spark, s, y).repartition(n), "score", "label").first()
        assert (m["auroc"], m["auprc"], m["minpse"]) == pytest.approx(want, abs=1e-9)


def test_groups_and_weights(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(2000) < 0.6, 0, rng.integers(1, 6, 2000))
    s, y, w = rng.random(2000).round(2), rng.integers(0, 2, 2000), rng.integers(0, 4, 2000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(g, s, y, w)], "g double, score double, y double, w double")
    df = df.select(F.col("g").cast("int").alias("g"), "score", F.col("y").cast("int").alias("label"), F.col("w").cast("int").alias("w"))
    got = {r["g"]: r for r in metrics.binary_metrics(df, "score", "label", ["g"], "w").collect()}
    for k in range(6):
        m = g == k
        rs, ry = np.repeat(s[m], w[m]), np.repeat(y[m], w[m])
        assert got[k]["auroc"] == pytest.approx(auc(rs, ry)) and got[k]["auprc"] == pytest.approx(ap(rs, ry))
        assert got[k]["brier"] == pytest.approx(((rs - ry) ** 2).mean())


def test_monotone_transform_keeps_auc(spark):
    df = table(spark, SCORES, LABELS)
    a = metrics.roc_auc(df, "score", "label").first()[0]
    assert metrics.roc_auc(df.withColumn("score", F.exp("score") * 5), "score", "label").first()[0] == a


def test_multiclass(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(300, 4))
    y = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(list(map(float, r)), int(c)) for r, c in zip(z, y)], "probs array<double>, label int")
    d = metrics.as_probabilities(df, "probs")
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    got = {r["scope"]: r["auc"] for r in metrics.ovr_auc(d, "probs", "label").collect()}
    per = [auc(p[:, c], (y == c).astype(int)) for c in range(4)]
    assert [got[f"class_{c}"] for c in range(4)] == pytest.approx(per)
    assert got["macro"] == pytest.approx(np.mean(per))
    assert got["weighted"] == pytest.approx(np.average(per, weights=np.bincount(y)))
    assert got["micro"] == pytest.approx(auc(p.ravel(), np.eye(4)[y].ravel().astype(int)))
    rep = metrics.multiclass_report(d, "probs", "label").first()
    pred = p.argmax(1)
    f1 = [2 * ((pred == c) & (y == c)).sum() / ((pred == c).sum() + (y == c).sum()) for c in range(4)]
    assert rep["accuracy"] == pytest.approx((pred == y).mean()) and rep["f1_macro"] == pytest.approx(np.mean(f1))
    hit = p >= 0.5
    half = [2 * (hit[:, c] & (y == c)).sum() / max(1, hit[:, c].sum() + (y == c).sum()) for c in range(4)]
    assert rep["f1_macro_half"] == pytest.approx(np.mean(half))


def test_probabilities_are_left_alone(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.2, 0.8],)], "probs array<double>")
    assert metrics.as_probabilities(df, "probs") is df


def test_regression_and_losses(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.5)], "pred double, label double")
    m = metrics.regression_metrics(df, "pred", "label").first()
    assert m["mae"] == pytest.approx(0.5) and m["mse"] == pytest.approx(1.25 / 3) and m["rmse"] == pytest.approx(math.sqrt(1.25 / 3))
    assert m["r2"] == pytest.approx(1 - 1.25 / 3 / np.var([2, 3, 4.5]))
    b = spark.createDataFrame([(0.0, 1.0), (0.5, 0.0)], "pred double, label double")
    assert metrics.loss(b, "bce").first()[0] == pytest.approx((100 + math.log(2)) / 2)
    c = spark.createDataFrame([([1.0, 2.0], 1)], "pred array<double>, label int")
    assert metrics.loss(c, "cross_entropy").first()[0] == pytest.approx(math.log(1 + math.exp(-1)))


def test_epochs_and_choices(spark):
    e = spark.createDataFrame([("r", 1, "auprc", 0.5), ("r", 2, "auprc", 0.7), ("r", 3, "auprc", 0.7)],
                              "run string, epoch int, metric string, value double")
    assert metrics.best_epoch(e, "auprc", "mortality").first()["epoch"] == 2
    assert metrics.best_epoch(e, "auprc", "los").first()["epoch"] == 1
    none = spark.createDataFrame([(None, "A")], "pred string, label string")
    with pytest.raises(Exception, match="no valid predictions"):
        metrics.choice_validity(none, "pred", "label").collect()


def weights_of(df, cols, draws, seed):
    return [(tuple(r[c] for c in cols), np.frombuffer(r["w"], "<i4")) for r in bootstrap.weighted_cells(df, cols, draws, seed).collect()]


def test_cell_weights_are_exact_draws(spark, partitions):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), (F.col("id") % 2).alias("b"))
    w = weights_of(df, ["a", "b"], 400, 1)
    assert len(w) == 14 and (sum(x for _, x in w) == 5000).all()
    assert all(abs(x.mean() - 5000 / 14) < 5 and abs(x.std() / np.sqrt(5000 / 14 * 13 / 14) - 1) < 0.15 for _, x in w)
    partitions(3)
    again = weights_of(df.repartition(5), ["a", "b"], 400, 1)
    assert sorted((k, x.tolist()) for k, x in w) == sorted((k, x.tolist()) for k, x in again)


def test_cells_split_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS_PER_PIECE", 50)
    w = np.stack([x for _, x in weights_of(spark.range(1000).select("id"), ["id"], 60, 2)])
    assert w.shape == (1000, 60) and (w.sum(axis=0) == 1000).all()
    assert 1.9 < (w * w).mean() < 2.1  # E[w^2] = 2 - 1/N


def test_shares_of_a_tree_add_up():
    sizes = np.array([5, 0, 7, 100, 1, 0, 30])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    parts = [bootstrap.share(ends, i, 500, 9) for i in range(7)]
    assert (sum(p[0] for p in parts) == 143).all() and not parts[1][0].any() and not parts[5][0].any()
    for i in range(7):
        assert (parts[i][1] == sum((p[0] for p in parts[:i]), np.zeros(500, int))).all()
    assert [p[0].mean() for p in parts] == pytest.approx(sizes, rel=0.15, abs=0.2)


@pytest.mark.parametrize("ranges", [1, 40])
def test_weighted_curves_equal_repeated_rows(spark, monkeypatch, ranges):
    """Each replicate's report is that of the plain metrics over its rows, in one range of scores or many; a missing score
    is the lowest."""
    monkeypatch.setattr(bootstrap, "CELLS_PER_PIECE", 200 // ranges)
    rng = np.random.default_rng(4)
    rows = [(i % 2 - 1, float(s), int(y), rng.integers(0, 3, 6)) for i, (s, y) in enumerate(zip(rng.random(200).round(2), rng.random(200) < 0.4))]
    df = spark.createDataFrame([(c, s, y, bytearray(w.astype("<i4").tobytes())) for c, s, y, w in rows], "class int, score double, hit int, w binary")
    got = {(r["class"], r["replicate"]): r for r in bootstrap.curve_replicates(df, 6).collect()}
    flat = spark.createDataFrame([(c, b, s, y, int(w[b])) for c, s, y, w in rows for b in range(6) if w[b]], "class int, replicate int, score double, y int, weight int")
    want = metrics.binary_metrics(flat, "score", "y", ["class", "replicate"], "weight").collect()
    assert len(want) == len(got) == 12
    for r in want:
        for c in bootstrap.BINARY:
            assert got[r["class"], r["replicate"]][c] == pytest.approx(r[c], abs=1e-12), c


def test_multiclass_replicates_equal_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS_PER_PIECE", 30)
    rng = np.random.default_rng(6)
    p = rng.dirichlet(np.ones(3), 80).round(3)
    rows = [(x.tolist(), int(rng.choice(3, p=x / x.sum())), rng.integers(0, 3, 5)) for x in p]
    df = spark.createDataFrame([(x, y, bytearray(w.astype("<i4").tobytes())) for x, y, w in rows], "p array<double>, y int, w binary")
    got = {r["replicate"]: r for r in bootstrap.multiclass_replicates(df, "p", "y", 5, 3).collect()}
    flat = spark.createDataFrame([(b, x, y, int(w[b])) for x, y, w in rows for b in range(5) if w[b]], "replicate int, p array<double>, y int, weight int")
    want = bootstrap.multiclass_wide(flat, "p", "y", ["replicate"], "weight").collect()
    assert len(want) == len(got) == 5
    for r in want:
        for c in bootstrap.MULTICLASS:
            assert got[r["replicate"]][c] == pytest.approx(r[c], abs=1e-12), c


def test_cell_draws_over_many_ranges(spark, monkeypatch, partitions):
    """The scan over ranges gives the same replicates for every partitioning, with totals that fit the table."""
    monkeypatch.setattr(bootstrap, "CURVE_CELLS", 10)
    rng = np.random.default_rng(3)
    s = rng.random(500).round(2)
    df = spark.createDataFrame([(float(a), int(rng.random() < a)) for a in s] + [(None, 0)], "s double, y int")
    rows = [sorted(map(tuple, bootstrap.binary_replicates(d, "s", "y", 30, 4).collect())) for d in (df, df.repartition(7)) if partitions(5) is None]
    assert rows[0] == rows[1] and len(rows[0]) == 30
    per = bootstrap.binary_replicates(df, "s", "y", 30, 4).collect()
    assert {r["n_pos"] + r["n_neg"] for r in per} == {501} and len({r["n_pos"] for r in per}) > 5


def test_both_bootstraps_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    s = rng.random(400).round(3)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id int, score double, label int")
    sims = [auc(s[i], y[i]) for i in (rng.integers(0, 400, 400) for _ in range(400))]
    for id_col in ("id", None):
        out = {r["metric"]: r for r in bootstrap.bootstrap_binary(df, "score", "label", 300, id_col=id_col).collect()}
        r = out["auroc"]
        assert r["n_bootstrap"] == 300 and r["value"] == pytest.approx(auc(s, y))
        assert r["mean"] == pytest.approx(np.mean(sims), abs=0.006) and r["std"] == pytest.approx(np.std(sims), rel=0.2)
        assert r["ci_lower"] == pytest.approx(np.percentile(sims, 2.5), abs=0.012)


def test_task_dispatch(spark):
    df = table(spark, SCORES, LABELS).withColumnRenamed("score", "pred")
    got = {r["metric"]: r["value"] for r in task_metrics(df, "mortality").collect()}
    assert got["auroc"] == pytest.approx(0.75) and set(got) == {"auroc", "auprc", "minpse", "f1", "best_f1", "accuracy"}
    vec = df.withColumn("label", F.array(F.lit(0), F.lit(0), "label"))
    assert {r["metric"]: r["value"] for r in task_metrics(vec, "readmission").collect()} == got
    probs = df.select(F.array(F.lit(1) - F.col("pred"), "pred").alias("pred"), "label")
    multi = {r["metric"]: r["value"] for r in task_metrics(probs, "multiclass").collect()}
    assert multi["auc_macro"] == pytest.approx(0.75) and multi["accuracy"] == pytest.approx(
        np.mean(np.stack([1 - np.array(SCORES), SCORES], 1).argmax(1) == np.array(LABELS)))  # 0.5 against 0.5 is class 0
    one = {r["metric"]: r["value"] for r in task_metrics(probs.filter("label = 1"), "multiclass").collect()}
    assert one["auc_macro"] == 0.0
    los = task_metrics(df.withColumn("label", F.col("pred") + 1), "los", los_info={"los_mean": 3.0, "los_std": 2.0}, bootstrap=True, draws=20)
    assert {r["metric"]: r["mean"] for r in los.collect()}["mae"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        task_metrics(df, "other")
