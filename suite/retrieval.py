"""Vectors, graph, cohorts, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions.hashing import hash_prefix
from cohortflow.operators import cohorts, entropy, retrieval, splits, vectors
from cohortflow.operators.scoring import score_batches
from cohortflow.plans.retrieve import RetrievalSettings, retrieve
from cohortflow.session import drop_table, written, written_with

from .base import SEED, floyd_sql, query, r6, sql_hash, table

UNIT = """
raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
un AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM raw)"""
KNN = f"""{UNIT},
pr AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.u, b.u), 12) AS weight FROM un a JOIN un b ON a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM pr) WHERE rn <= 4),
und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, avg(weight) AS weight FROM knn GROUP BY 1, 2)"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


@query("l2_normalize", f"WITH {UNIT} SELECT vec_id, round(u[1], 6) AS u1, round(u[64], 6) AS u64, round(list_dot_product(u, u), 6) AS len FROM un")
def l2_normalize(spark, sf):
    u = _emb(spark, sf).select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    length = vectors.norm(F.col("u"))
    return u.select("vec_id", r6(F.col("u")[0], "u1"), r6(F.col("u")[63], "u64"), r6(length * length, "len"))


def _knn(spark, sf, **blocks):
    return vectors.knn_graph(_emb(spark, sf), "vec_id", "embedding", 4, **blocks)


@query("knn_graph", f"WITH {KNN} SELECT src, dst, round(weight, 6) AS weight FROM knn")
def knn_graph(spark, sf):
    return _knn(spark, sf).select("src", "dst", r6("weight"))


@query("knn_graph_blocks", f"WITH {KNN} SELECT src, dst, round(weight, 6) AS weight FROM knn")
def knn_graph_blocks(spark, sf):
    return _knn(spark, sf, block_rows=200).select("src", "dst", r6("weight"))


CENT = f"""{UNIT},
ce AS (SELECT label AS cohort, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM
        (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM raw) GROUP BY 1, 2) GROUP BY 1),
cs AS (SELECT vec_id AS query_id, cohort, round(list_dot_product(u, c) / (sqrt(list_dot_product(c, c)) + 1e-12), 12) AS weight FROM un CROSS JOIN ce),
tc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, cohort) AS rank FROM cs) WHERE rank <= 3)"""


@query("cosine_pairs", f"WITH {CENT} SELECT query_id AS src, cohort AS dst, round(weight, 6) AS weight FROM cs")
def cosine_pairs(spark, sf):
    e = _emb(spark, sf)
    rows = vectors.cosine_rows(e, vectors.centroids(e, "label", "embedding"), "vec_id", "embedding", "cohort", "centroid")
    flat = rows.select("src", F.explode(F.arrays_zip("dst", "sims")).alias("p"))
    return flat.select("src", F.col("p.dst").alias("dst"), r6(F.col("p.sims"), "weight"))


@query("undirect", f"WITH {KNN} SELECT a, b, round(weight, 6) AS weight FROM und")
def undirect(spark, sf):
    return cohorts.undirect(_knn(spark, sf)).select("a", "b", r6("weight"))


@query("rescale_weights", f"""WITH {KNN}
SELECT a, b, round(1 + 2 * (weight - (SELECT min(weight) FROM und)) / ((SELECT max(weight) FROM und) - (SELECT min(weight) FROM und)), 6) AS width FROM und""")
def rescale_weights(spark, sf):
    return cohorts.rescale_weights(cohorts.undirect(_knn(spark, sf))).select("a", "b", r6("width"))


@query("centroids", f"WITH {CENT} SELECT cohort, round(c[1], 6) AS c1, round(c[33], 6) AS c33, round(c[64], 6) AS c64 FROM ce")
def centroids(spark, sf):
    c = vectors.centroids(_emb(spark, sf), "label", "embedding")
    v = F.col("centroid")
    return c.select("cohort", r6(v[0], "c1"), r6(v[32], "c33"), r6(v[63], "c64"))


@query("partition_quality", f"""WITH {KNN},
sz AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
s AS (SELECT CAST(sum(size) AS BIGINT) AS n_nodes, count(*) AS n_cohorts, min(size) AS min_size, max(size) AS max_size, sum(size * (size - 1) / 2) AS pairs FROM sz),
i AS (SELECT sum(CASE WHEN x.label = y.label THEN weight ELSE 0 END) AS inner_weight, sum(weight) AS total FROM und
      JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b)
SELECT n_nodes, n_cohorts, min_size, max_size, round(inner_weight, 6) AS inner_weight,
       round(inner_weight - 0.9 * 2 * total / (n_nodes * (n_nodes - 1)) * pairs, 6) AS quality FROM s CROSS JOIN i""")
def partition_quality(spark, sf):
    labels = _emb(spark, sf).select(F.col("vec_id").alias("node"), F.col("label").alias("cohort"))
    q = cohorts.partition_quality(cohorts.undirect(_knn(spark, sf)), labels, 0.9)
    return q.select("n_nodes", "n_cohorts", "min_size", "max_size", r6("inner_weight"), r6("quality"))


@query("sample_subgraph", f"""WITH {KNN},
k AS (SELECT vec_id AS node FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('vec_id', str(SEED))}, vec_id) AS rn FROM embeddings)
      WHERE rn <= 200 // (SELECT count(DISTINCT label) FROM embeddings))
SELECT a, b, round(weight, 6) AS weight FROM und WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)""")
def sample_subgraph(spark, sf):
    nodes = _emb(spark, sf).select(F.col("vec_id").alias("node"), F.col("label").alias("cohort"))
    _, edges = splits.sample_subgraph(nodes, cohorts.undirect(_knn(spark, sf)), 200, SEED)
    return edges.select("a", "b", r6("weight"))


@query("detect_cohorts")
def detect_cohorts(spark, sf):
    nodes = _emb(spark, sf).select(F.col("vec_id").alias("node"))
    return cohorts.detect_cohorts(nodes, cohorts.undirect(_knn(spark, sf)))


@query("cohort_properties", """
SELECT count(*) AS n_nodes, count(*) AS n_covered, 0 AS n_unreached, TRUE AS beats_singletons, TRUE AS beats_one_cohort FROM embeddings""")
def cohort_properties(spark, sf):
    """Found cohorts cover all nodes, each is connected, and the quality beats both trivial labellings."""
    nodes = _emb(spark, sf).select(F.col("vec_id").alias("node"))
    und = written(cohorts.undirect(_knn(spark, sf)), "edges")
    found = written(cohorts.detect_cohorts(nodes, und), "cohorts")
    ends = found.select(F.col("node").alias("b"), F.col("cohort").alias("cb"))
    inner = und.join(found.withColumnRenamed("node", "a"), "a").join(ends, "b").filter("cohort = cb").select("a", "b")
    both = written(inner.unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"))), "inner")
    # A cohort is named by its smallest member: everything in it must be reached from there.
    reached = found.select("cohort").distinct().select(F.col("cohort").alias("node"))
    size = 0
    while True:
        step = reached.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"))
        reached, seen = written_with(reached.union(step).distinct(), "reached", n=F.count(F.lit(1)))
        if seen["n"] == size:
            break
        size = seen["n"]
    quality = [cohorts.partition_quality(und, c).select("quality") for c in (
        found, nodes.withColumn("cohort", F.col("node")), nodes.withColumn("cohort", F.lit(0)))]
    got, single, one = (q.first()["quality"] for q in quality)
    counts = nodes.join(found, "node", "left").join(reached.withColumn("hit", F.lit(1)), "node", "left")
    return counts.agg(F.count("node").alias("n_nodes"), F.count("cohort").alias("n_covered"),
                      F.count_if(F.col("hit").isNull()).cast("int").alias("n_unreached")).select(
        "*", F.lit(got > single).alias("beats_singletons"), F.lit(got > one).alias("beats_one_cohort"))


def _queries(spark, sf):
    return _emb(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _members(spark, sf):
    return _emb(spark, sf).select(F.col("label").alias("cohort"), F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))


def _cands(spark, sf):
    return retrieval.top_cohorts(_queries(spark, sf), vectors.centroids(_emb(spark, sf), "label", "embedding"), 3)


@query("top_cohorts", f"WITH {CENT} SELECT query_id, cohort, round(weight, 6) AS weight, rank FROM tc")
def top_cohorts(spark, sf):
    return _cands(spark, sf).select("query_id", "cohort", r6("weight"), "rank")


FRONT = f"""{CENT},
fw AS (SELECT t.query_id, t.cohort, m.vec_id AS node, round(list_dot_product(q.u, m.u), 12) AS weight FROM tc t
       JOIN un q ON q.vec_id = t.query_id JOIN un m ON m.label = t.cohort),
fr AS (SELECT DISTINCT query_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cohort ORDER BY weight DESC, node) AS rn FROM fw) WHERE rn <= 2)"""


def _frontier(spark, sf):
    cands = written(_cands(spark, sf).select("query_id", "cohort"), "candidates")
    return retrieval.frontier(_queries(spark, sf), cands, _members(spark, sf), 2)


@query("frontier", f"WITH {FRONT} SELECT query_id, node FROM fr")
def frontier(spark, sf):
    return _frontier(spark, sf)


@query("frontier_growth", f"""WITH {FRONT}, {KNN.replace(UNIT + ',', '')},
pk AS (SELECT query_id, min(node) AS node FROM fr GROUP BY 1)
SELECT DISTINCT pk.query_id, dst AS node FROM pk JOIN knn ON src = pk.node WHERE dst <> pk.node
AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.query_id = pk.query_id AND fr.node = dst)""")
def frontier_growth(spark, sf):
    front = written(_frontier(spark, sf), "frontier")
    picked = front.groupBy("query_id").agg(F.min("node").alias("node"))
    return retrieval.grow_frontier(picked, _knn(spark, sf), picked, front)


TOK = r"[\p{L}\p{N}_]{2,}"
PATIENTS = f"""
tb AS (SELECT id, CAST('0x' || substr(md5(term), 1, 4) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term
       FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) GROUP BY 1, 2),
tm AS (SELECT id, map_from_entries(list((b, n))) AS m FROM tb GROUP BY id),
pt0 AS (SELECT vec_id AS node, CAST(label AS BIGINT) AS label, text, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings JOIN documents ON vec_id = doc_id
        UNION ALL SELECT doc_id, 10 + CAST('0x' || substr(md5(coalesce(source, '')), 1, 2) AS BIGINT) % 8, text,
          list_transform(range(64), lambda j: CAST(coalesce(m[j], 0) AS DOUBLE)) FROM documents LEFT JOIN tm ON id = doc_id WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))"""


@query("exemplar_join", f"""WITH {PATIENTS},
pu AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM pt0),
pc AS (SELECT label AS cohort, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM pt0) GROUP BY 1, 2) GROUP BY 1),
ps AS (SELECT node, cohort, round(list_dot_product(u, c) / (sqrt(list_dot_product(c, c)) + 1e-12), 12) AS weight FROM pu CROSS JOIN pc),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, cohort) AS rank FROM ps) WHERE rank <= 3)
SELECT pk.cohort, count(text) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(label) AS BIGINT) AS labels FROM pk JOIN pt0 USING (node) GROUP BY pk.cohort""")
def exemplar_join(spark, sf):
    train = written(_all_patients(spark, sf), "patients")
    near = retrieval.top_cohorts(train.select(F.col("node").alias("query_id"), "vec"), vectors.centroids(train, "label", "vec"), 3)
    picks = near.select(F.col("cohort").alias("query_id"), "rank", F.col("query_id").alias("node"))
    joined = retrieval.attach_exemplars(picks, train.drop("vec"))
    return joined.groupBy(F.col("query_id").alias("cohort")).agg(
        F.count("detail").alias("n"), F.sum(F.length("detail")).alias("chars"), F.sum("label").alias("labels"))


@query("reverse_lookup", """
WITH t AS (SELECT d.doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
w AS (SELECT doc_id, text, quality FROM t)
SELECT w.doc_id AS query_id, min(t.doc_id) AS idx FROM w JOIN t ON t.text = w.text AND (w.quality IS NULL OR t.quality = w.quality) GROUP BY 1""")
def reverse_lookup(spark, sf):
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("detail"), F.col("quality").alias("label"))
    ex = t.select(F.col("idx").alias("query_id"), F.lit(1).alias("rank"), "detail", "label")
    return retrieval.reverse_lookup(ex, t).select("query_id", "idx")


# ---- entropy and walks ---------------------------------------------------------------------------------------------

def _all_patients(spark, sf):
    """All documents: with the vector and label of the same id, else with counts of their terms in 64 hash buckets as vector and
    a label by the source."""
    docs, emb = table(spark, sf, "documents"), _emb(spark, sf)
    given = emb.join(docs, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec"), F.col("text").alias("detail"), F.col("label").cast("bigint").alias("label"))
    others = docs.join(emb.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    counts = vectors.term_buckets(docs, "doc_id", "text", 64)  # of all: cheaper than a second shuffle of the others' texts
    label = 10 + hash_prefix(F.md5(F.coalesce("source", F.lit(""))), 2) % 8
    derived = others.join(counts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        F.col("doc_id").alias("node"), F.coalesce("vec", F.array_repeat(F.lit(0.0), 64)).alias("vec"), F.col("text").alias("detail"), label.alias("label"))
    return given.unionByName(derived)


def _patients(spark, sf):
    """All documents as patients, split into train, val and test."""
    every = written(_all_patients(spark, sf), "patients")
    split = written(splits.split_ratio(every, "node", 0.8, SEED), "patients")
    drop_table(every)
    return split


def _train_test(spark, sf):
    p = _patients(spark, sf)
    train = p.filter("split = 'train'").drop("split")
    test = p.filter("split <> 'train'").select(F.col("node").alias("query_id"), "vec", "detail")
    return train, test


# Train patients are nodes, all others are queries; known labels serve as cohorts.
WALK = f"""{PATIENTS},
pt AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u,
         row_number() OVER (ORDER BY {sql_hash('node', str(SEED))}, node) - 1 < floor((SELECT count(*) FROM pt0) * CAST(0.8 AS DOUBLE)) AS train FROM pt0),
ce AS (SELECT label AS cohort, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM
        (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM pt WHERE train) GROUP BY 1, 2) GROUP BY 1),
cs AS (SELECT node AS query_id, u, cohort, round(list_dot_product(u, c) / (sqrt(list_dot_product(c, c)) + 1e-12), 12) AS weight FROM pt CROSS JOIN ce WHERE NOT train),
tc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, cohort) AS rank FROM cs) WHERE rank <= 3),
fw AS (SELECT t.query_id, t.cohort, m.node, round(list_dot_product(t.u, m.u), 12) AS weight FROM tc t JOIN pt m ON m.label = t.cohort AND m.train),
fr AS (SELECT DISTINCT query_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cohort ORDER BY weight DESC, node) AS rn FROM fw) WHERE rn <= 2),
pr AS (SELECT a.node AS src, b.node AS dst, round(list_dot_product(a.u, b.u), 12) AS weight FROM pt a JOIN pt b ON a.node <> b.node WHERE a.train AND b.train),
eg AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM pr) WHERE rn <= 3),
qt AS (SELECT id AS query_id, term, count(*) AS c_q FROM (SELECT node AS id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM pt WHERE NOT train) GROUP BY 1, 2),
nt AS (SELECT id AS node, term, count(*) AS c FROM (SELECT node AS id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM pt WHERE train) GROUP BY 1, 2),
voc AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM (SELECT term FROM qt UNION SELECT term FROM nt)),
ql AS (SELECT query_id, sum(c_q) AS q_len FROM qt GROUP BY 1), nl AS (SELECT node, sum(c) AS n_len FROM nt GROUP BY 1),
b0 AS (SELECT query_id, ln(v) AS base FROM ql CROSS JOIN voc),
ad AS (SELECT fr.query_id, fr.node, sum(c_q * ln(c + 1.0)) AS added FROM fr JOIN qt USING (query_id) JOIN nt ON nt.node = fr.node AND nt.term = qt.term GROUP BY 1, 2),
sc AS (SELECT fr.query_id, fr.node, -(coalesce(added, 0) - q_len * ln(coalesce(n_len, 0) + v)) / q_len AS entropy FROM fr JOIN ql USING (query_id)
       LEFT JOIN ad ON ad.query_id = fr.query_id AND ad.node = fr.node LEFT JOIN nl ON nl.node = fr.node CROSS JOIN voc)"""


def _walk_inputs(spark, sf):
    """(frontier, edges, scorer) of the train/test patients with labels as cohorts."""
    train, test = _train_test(spark, sf)
    members = train.select(F.col("label").alias("cohort"), "node", "vec")
    cands = written(retrieval.top_cohorts(test, vectors.centroids(members, "cohort", "vec"), 3), "candidates")
    front = written(retrieval.frontier(test, cands, members, 2), "frontier")
    edges = vectors.knn_graph(train, "node", "vec", 3)
    return front, edges, entropy.UnigramScorer(test, train, "query_id", "detail", "node", "detail", 1.0)


@query("unigram_entropy", f"WITH {WALK} SELECT query_id, node, round(entropy, 6) AS entropy FROM sc")
def unigram_entropy(spark, sf):
    front, _, scorer = _walk_inputs(spark, sf)
    return scorer.score(front).select("query_id", "node", r6("entropy"))


@query("info_gain", f"WITH {WALK} SELECT query_id, node, round(base - entropy, 6) AS gain FROM sc JOIN b0 USING (query_id)")
def info_gain(spark, sf):
    front, _, scorer = _walk_inputs(spark, sf)
    return entropy.info_gain(scorer.base(), scorer.score(front)).select("query_id", "node", r6("gain"))


@query("avg_entropy", f"WITH {WALK} SELECT round(avg(entropy), 6) AS avg_entropy FROM sc")
def avg_entropy(spark, sf):
    front, _, scorer = _walk_inputs(spark, sf)
    return entropy.avg_entropy(scorer.score(front)).select(r6("avg_entropy"))


FIRST = f"""{WALK}, fp AS (SELECT query_id, node, base - entropy AS gain, row_number() OVER (PARTITION BY query_id ORDER BY round(base - entropy, 12) DESC, node) AS rn
            FROM sc JOIN b0 USING (query_id) WHERE base - entropy > 0)"""


@query("greedy_first_pick", f"WITH {FIRST} SELECT query_id, node, round(gain, 6) AS gain FROM fp WHERE rn = 1")
def greedy_first_pick(spark, sf):
    return retrieval.greedy_walk(*_walk_inputs(spark, sf), 1).select("query_id", "node", r6("gain"))


# Second and third pick spelled out as further SQL rounds over the grown frontier.
def _round_sql(i: int) -> str:
    p, c = i - 1, i
    return f"""
sel{p} AS (SELECT query_id, node FROM pick1 {' '.join(f'UNION ALL SELECT query_id, node FROM pick{j}' for j in range(2, i))}),
fr{c} AS (SELECT f.query_id, f.node FROM (SELECT query_id, node FROM fr{p if p > 1 else ''} UNION
             SELECT k.query_id, e.dst FROM pick{p} k JOIN eg e ON e.src = k.node) f
          WHERE f.query_id IN (SELECT query_id FROM pick{p}) AND NOT EXISTS (SELECT 1 FROM sel{p} s WHERE s.query_id = f.query_id AND s.node = f.node)),
cs{c} AS (SELECT s.query_id, nt.term, sum(c) AS c_s FROM sel{p} s JOIN nt ON nt.node = s.node GROUP BY 1, 2),
ns{c} AS (SELECT s.query_id, sum(n_len) AS n_s FROM sel{p} s JOIN nl ON nl.node = s.node GROUP BY 1),
tm{c} AS (SELECT qt.query_id, qt.term, c_q, coalesce(c_s, 0) AS c_s FROM qt LEFT JOIN cs{c} x ON x.query_id = qt.query_id AND x.term = qt.term),
lg{c} AS (SELECT query_id, sum(c_q * ln(c_s + 1.0)) AS logs FROM tm{c} GROUP BY 1),
ad{c} AS (SELECT f.query_id, f.node, sum(c_q * (ln(c_s + c + 1.0) - ln(c_s + 1.0))) AS added FROM fr{c} f JOIN tm{c} t ON t.query_id = f.query_id
          JOIN nt ON nt.node = f.node AND nt.term = t.term GROUP BY 1, 2),
gn{c} AS (SELECT f.query_id, f.node, (-(logs - q_len * ln(n_s + v)) / q_len) - (-(logs + coalesce(added, 0) - q_len * ln(n_s + coalesce(n_len, 0) + v)) / q_len) AS gain
          FROM fr{c} f JOIN ql ON ql.query_id = f.query_id JOIN lg{c} l ON l.query_id = f.query_id JOIN ns{c} n ON n.query_id = f.query_id
          LEFT JOIN ad{c} a ON a.query_id = f.query_id AND a.node = f.node LEFT JOIN nl ON nl.node = f.node CROSS JOIN voc),
pick{c} AS (SELECT query_id, node, gain FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(gain, 12) DESC, node) AS rn FROM gn{c} WHERE gain > 0) WHERE rn = 1)"""


PICKS = f"""{FIRST},
pick1 AS (SELECT query_id, node, gain FROM fp WHERE rn = 1),{_round_sql(2)},{_round_sql(3)},
picks AS (SELECT query_id, 1 AS rank, node, gain FROM pick1 UNION ALL SELECT query_id, 2, node, gain FROM pick2
          UNION ALL SELECT query_id, 3, node, gain FROM pick3)"""


@query("greedy_walk", f"WITH {PICKS} SELECT query_id, rank, node, round(gain, 6) AS gain FROM picks")
def greedy_walk(spark, sf):
    w = retrieval.greedy_walk(*_walk_inputs(spark, sf), 3)
    return w.select("query_id", "rank", "node", r6("gain"))


# Certified bounds: the same picks as the walk that scores everyone.
@query("greedy_walk_lazy", f"WITH {PICKS} SELECT query_id, rank, node, round(gain, 6) AS gain FROM picks")
def greedy_walk_lazy(spark, sf):
    w = retrieval.lazy_walk(*_walk_inputs(spark, sf), 3)
    return w.select("query_id", "rank", "node", r6("gain"))


def _retrieve(spark, sf, mode, known_cohorts=False):
    train, test = _train_test(spark, sf)
    given = train.select("node", F.col("label").alias("cohort")) if known_cohorts else None
    found = retrieve(train, test, RetrievalSettings(mode=mode), given)
    return found.select("query_id", "rank", "node", "label", F.length("detail").alias("detail_chars"))


@query("retrieve")
def retrieve_query(spark, sf):
    return _retrieve(spark, sf, "rounds")


@query("retrieve_given_cohorts", f"""WITH {PICKS}
SELECT query_id, rank, p.node, label, CAST(length(text) AS INTEGER) AS detail_chars FROM picks p JOIN pt ON pt.node = p.node""")
def retrieve_given_cohorts(spark, sf):
    return _retrieve(spark, sf, "rounds", known_cohorts=True)


@query("retrieve_random", f"""WITH {WALK},
plc AS (SELECT label AS cohort, node, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('node', str(SEED))}, node) - 1 AS pos FROM pt WHERE train),
szs AS (SELECT cohort, count(*) AS size FROM plc GROUP BY 1),
cnd AS (SELECT query_id, cohort, size, sum(size) OVER (PARTITION BY query_id ORDER BY cohort) - size AS start, sum(size) OVER (PARTITION BY query_id) AS pool_size
        FROM tc JOIN szs USING (cohort)), {floyd_sql('cnd', 'plc', SEED)}
SELECT query_id, rank, d.node, label, CAST(length(text) AS INTEGER) AS detail_chars FROM drawn d JOIN pt ON pt.node = d.node""")
def retrieve_random(spark, sf):
    return _retrieve(spark, sf, "random", known_cohorts=True)


@query("tfidf_embed", f"""
WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM documents),
c AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
vc AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM c CROSS JOIN n GROUP BY term, n),
w AS (SELECT id, term, tf * idf AS w FROM c JOIN vc USING (term)), l AS (SELECT id, sqrt(sum(w * w)) + 1e-12 AS len FROM w GROUP BY id)
SELECT id, term, round(w / len, 6) AS w FROM w JOIN l USING (id)
UNION ALL SELECT doc_id, NULL, 0.0 FROM documents WHERE doc_id NOT IN (SELECT id FROM c)""")
def tfidf_embed(spark, sf):
    return vectors.tfidf_embed(table(spark, sf, "documents"), "doc_id", "text").select("id", "term", r6("w"))


def _mean_scorer():
    def score(pdf):
        import numpy as np

        m = np.array(pdf["embedding"].tolist(), dtype=float).reshape(len(pdf), -1).sum(axis=1)
        return pdf[["vec_id"]].assign(total=m.round(4))
    return score


@query("score_batches", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def score_batches_query(spark, sf):
    return score_batches(_emb(spark, sf).select("vec_id", "embedding"), _mean_scorer, "vec_id bigint, total double")
