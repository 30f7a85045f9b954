import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import vectors


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids if ids is not None else range(len(x)), x)],
                                 "id bigint, vec array<double>")


def brute(a, b, k, exclude_self=False):
    def unit(x):
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    w = np.round(unit(a) @ unit(b).T, 12)
    out = {}
    for i in range(len(a)):
        order = sorted((j for j in range(len(b)) if not (exclude_self and i == j)), key=lambda j: (-w[i, j], j))
        out[i] = [(j, w[i, j]) for j in order[:k]]
    return out


def edges(df):
    out = {}
    for r in df.orderBy("src", F.desc("weight"), "dst").collect():
        out.setdefault(r["src"], []).append((r["dst"], r["weight"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]], i
        assert [w for _, w in got[i]] == pytest.approx([w for _, w in want[i]], abs=1e-9)


@pytest.mark.parametrize("block", [2048, 40])
def test_neighbours_match_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 8)) for c in (0, 2, -2)])
    same(edges(vectors.knn_graph(frame(spark, x), "id", "vec", 4, block_rows=block)), brute(x, x, 4, True))


@pytest.mark.parametrize("block", [2048, 16])
def test_a_third_of_copies(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6))
    x[::3] = x[0]
    same(edges(vectors.knn_graph(frame(spark, x), "id", "vec", 3, block_rows=block)), brute(x, x, 3, True))


def test_few_rows(spark):
    x = np.eye(3)
    got = edges(vectors.knn_graph(frame(spark, x), "id", "vec", 5))
    assert {i: len(v) for i, v in got.items()} == {0: 2, 1: 2, 2: 2} and all(i not in [j for j, _ in v] for i, v in got.items())


@pytest.mark.parametrize("block", [2048, 12])
def test_two_sets(spark, block):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 5)), rng.normal(size=(70, 5))
    b[10:40] = b[5]
    found = vectors.all_pairs_topk(frame(spark, a), frame(spark, b), 4, block_rows=block)
    same(edges(found), brute(a, b, 4))
    assert {r["rank"] for r in found.collect()} == {1, 2, 3, 4}


def test_zero_vectors_have_no_direction(spark):
    x = np.zeros((5, 3))
    x[0] = 1
    got = edges(vectors.knn_graph(frame(spark, x), "id", "vec", 2))
    assert [j for j, _ in got[3]] == [0, 1] and [w for _, w in got[3]] == [0, 0]


def test_ball_tree_compares_few_of_clustered_vectors(spark):
    """Exact, with several levels of pivots, nearly equal vectors that no pivot parts, and far fewer products than pairs."""
    rng = np.random.default_rng(12)
    x = np.concatenate([c + 0.02 * rng.normal(size=(40, 8)) for c in rng.normal(size=(50, 8))] + [np.ones((60, 8)) + 1e-14 * np.arange(60)[:, None]])
    effort: list = []
    df = frame(spark, x)
    same(edges(vectors.knn_graph(df, "id", "vec", 3, block_rows=20, effort=effort)), brute(x, x, 3, True))
    assert len(effort) == 3 and sum(effort) < 0.2 * len(x) ** 2
    *_, nodes, depth = vectors.ball_tree(df.select("id", vectors.l2_normalize(F.col("vec")).alias("vec")), df.select(F.col("id").alias("first"), vectors.l2_normalize(F.col("vec")).alias("vec")), 20, 4)
    assert depth >= 3 and nodes.count() > 100


def test_right_blocks_go_out_in_chunks(spark):
    """Several chunks of right blocks, each a few blocks, give what one gives; also with zero vectors and copies."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=(150, 6)), 3 + 0.05 * rng.normal(size=(80, 6)), np.zeros((5, 6)), np.ones((9, 6))])
    same(edges(vectors.knn_graph(frame(spark, x), "id", "vec", 4, block_rows=16, small_bytes=3000)), brute(x, x, 4, True))


def test_vectors_that_no_ball_parts_leave_few_rows(spark, monkeypatch):
    """Blocks meet nearly all others here: what tasks give out is a few rows for each left row, not some for each pair of
    blocks, and the tables of the search are removed at its end."""
    sizes, made, write = [], [], vectors.written

    def counted(df, name="table"):
        out = write(df, name)
        made.extend(out.inputFiles())
        if name == "found":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(vectors, "written", counted)
    x = np.random.default_rng(22).normal(size=(600, 24))
    got = vectors.knn_graph(frame(spark, x), "id", "vec", 3, block_rows=20)
    same(edges(got), brute(x, x, 3, True))
    assert sum(sizes) < 6 * 4 * len(x)
    left = [f for f in made if os.path.exists(f.removeprefix("file://"))]
    assert made and not left


@pytest.mark.parametrize("small", [32 * 1024 * 1024, 500])
def test_groups_go_out_in_chunks(spark, monkeypatch, small):
    monkeypatch.setattr(vectors, "SMALL_BYTES", small)
    rng = np.random.default_rng(23)
    a, b, g = rng.normal(size=(30, 4)), rng.normal(size=(80, 4)), np.where(np.arange(80) < 70, 0, 1)
    left = frame(spark, a).withColumn("cohort", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    right = frame(spark, b).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(g)], "id bigint, cohort int"), "id")
    got = {(r["src"], r["cohort"], r["rank"]): r["dst"] for r in vectors.topk_in_groups(left, right, 3, block_rows=8).collect()}
    want = {}
    for c in (0, 1):
        ids = np.nonzero(g == c)[0]
        want |= {(i, c, r + 1): ids[j] for i, near in brute(a, b[ids], 3).items() for r, (j, _) in enumerate(near)}
    assert got == want


@pytest.mark.parametrize("block", [2048, 10])
def test_top_in_one_hot_group(spark, block):
    rng = np.random.default_rng(4)
    b, g = rng.normal(size=(90, 4)), np.where(np.arange(90) < 60, 0, np.arange(90) % 5 + 1)
    a = rng.normal(size=(40, 4))
    left = frame(spark, a).withColumn("cohort", F.explode(F.array(F.lit(0), F.lit(3))))
    right = frame(spark, b).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(g)], "id bigint, cohort int"), "id")
    got = {(r["src"], r["cohort"], r["rank"]): r["dst"] for r in vectors.topk_in_groups(left, right, 2, block_rows=block).collect()}
    for c in (0, 3):
        ids = np.nonzero(g == c)[0]
        want = brute(a, b[ids], 2)
        for i in range(40):
            for r, (j, _) in enumerate(want[i]):
                assert got[(i, c, r + 1)] == ids[j]
    assert len(got) == 160


def test_dense_rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(11, 3))
    got = {}
    for r in vectors.cosine_rows(frame(spark, a), frame(spark, b), block_rows=4).collect():
        for j, w in zip(r["dst"], r["sims"]):
            got[(r["src"], j)] = w
    want = {(i, j): w for i, v in brute(a, b, 11).items() for j, w in v}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_tfidf(spark):
    df = spark.createDataFrame([(0, "Der Hund, der hund!"), (1, "a Katze é1 der"), (2, "")], "id int, text string")
    rows = {(r["id"], r["term"]): r["w"] for r in vectors.tfidf_embed(df, "id", "text").collect()}
    assert set(rows) == {(0, "der"), (0, "hund"), (1, "katze"), (1, "é1"), (1, "der"), (2, None)} and rows[(2, None)] == 0
    idf = {t: np.log(4 / (1 + n)) + 1 for t, n in (("der", 2), ("hund", 1))}
    a, b = 2 * idf["der"], 2 * idf["hund"]
    assert rows[(0, "der")] == pytest.approx(a / np.hypot(a, b))
    two = vectors.tfidf_embed(df, "id", "text", 2)
    assert {r["term"] for r in two.collect()} == {"der", "hund", None}
    dense = {r["id"]: r["vec"] for r in vectors.sparse_to_dense(two).collect()}
    assert dense[0] == pytest.approx([a / np.hypot(a, b), b / np.hypot(a, b)]) and dense[1] == pytest.approx([1, 0])
    assert dense[2] == [0, 0]
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "src int, dst int")
    dots = {(r["src"], r["dst"]): r["weight"] for r in vectors.sparse_dots(two, two, pairs).collect()}
    assert dots[(0, 1)] == pytest.approx(a / np.hypot(a, b)) and dots[(0, 2)] == 0


def test_centroids(spark):
    df = frame(spark, np.array([[1, 2], [3, 4], [5, 5]])).withColumn("c", (F.col("id") == 2).cast("int"))
    assert {r["cohort"]: r["centroid"] for r in vectors.centroids(df, "c", "vec").collect()} == {0: [2, 3], 1: [5, 5]}
