"""Vectors: normalisation, TF-IDF, exact top-k cosine search, centroids.

Exact search never lists pairs. Small right sides (checked bytes) go to every task; larger ones form a ball tree in
tables, whose pivots grow with the data: blocks of left rows descend it, and balls that cannot beat the current k-th
neighbour are skipped with all that is below them, by an exact angle bound. Right blocks go to the tasks in chunks of
checked bytes, so no vector is copied for a pair of blocks; only rows that can beat the k-th weight leave a task. Block
products run in numpy: in single precision with its error bound first, what may count then in double.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalars import array_sum, let
from ..session import Scope, drop_table, written, written_with
from .joins import join_per_key
from .ordering import first_n, numbered

BLOCK_ROWS = 2048
SMALL_BYTES = 32 * 1024 * 1024
BRANCH = 32  # pivots of a node of the ball tree
NEAREST = 4  # leaves that a block visits before the others are bounded again
TILE = 1 << 19  # products at once
SLACK = 1e-9  # angles are compared with a little room, so rounding can only keep a block, never drop it


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def l2_normalize(c: Column, eps: float = 1e-12) -> Column:
    """Row divided by (its length + eps)."""
    return let(norm(c) + F.lit(eps), lambda n: F.transform(c, lambda v: v.cast("double") / n))


def with_unit(df: DataFrame, id_col: str, vec: str, *keep: str) -> DataFrame:
    """(id, unit vector) and the columns to keep."""
    return df.select(F.col(id_col).alias("id"), l2_normalize(F.col(vec)).alias("vec"), *keep)


def _evened(df: DataFrame, *keys) -> DataFrame:
    """Rows over all cores before a step whose work per byte is high; a few input files would else limit it."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(max(int(conf), df.sparkSession.sparkContext.defaultParallelism), *keys)


def centroids(df: DataFrame, cohort: str, vec: str) -> DataFrame:
    """Mean of the unnormalised member vectors per cohort, summed with map-side partials."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(F.col(cohort).alias("cohort")).agg(vector_to_array(mean).alias("centroid"))


# ---- TF-IDF --------------------------------------------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}_]{2,}"  # words of at least two letters, digits or underscores


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, term, tf)`` over whole texts."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return (df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term"))
            .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


def _tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("tokens"))


def _in_parts(batches):
    """(ids, number of tokens of each row, tokens of all) of some rows at a time."""
    import pyarrow.compute as pc

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            yield part.column(0), pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).flatten()


def _packed_counts(ids, offsets: np.ndarray, terms, counts: np.ndarray):
    """Rows (id, terms, counts, total): the terms of a row in one string, their counts as 32-bit numbers in one value."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(counts) and counts.max() >= 2 ** 31:
        raise OverflowError("a term occurs 2^31 times under one id")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), terms), " ")
    packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(counts.astype(np.int32))])
    total = np.concatenate([[0], np.cumsum(counts)])[offsets]
    return pa.RecordBatch.from_arrays([ids, text, packed, pa.array(np.diff(total), pa.int64())], names=["id", "terms", "counts", "total"])


def term_packs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """:func:`term_counts` in one row for each id that has terms: ``(id, terms, counts, total)``, written. Terms are counted in
    the task that reads the text; only where an id has several rows are they shuffled."""
    def count(batches):
        for ids, sizes, flat in _in_parts(batches):
            coded, have = flat.dictionary_encode(), np.flatnonzero(sizes)
            if not len(have):
                continue
            n = len(coded.dictionary)
            keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(keys, n)
            yield _packed_counts(ids.take(have), np.concatenate([[0], np.searchsorted(row, have, side="right")]), coded.dictionary.take(term), counts)

    def pack(batches):
        for batch in batches:
            terms, counts = batch.column(1), batch.column(2)
            yield _packed_counts(batch.column(0), np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]), terms.flatten(), counts.flatten().to_numpy())

    tokens = _tokens(df, id_col, text)
    schema = T.StructType([tokens.schema["id"], T.StructField("terms", T.StringType()), T.StructField("counts", T.BinaryType()), T.StructField("total", T.LongType())])
    packs, seen = written_with(tokens.mapInArrow(count, schema), "packs", n=F.count(F.lit(1)))
    if packs.agg(F.countDistinct("id").alias("n")).first()["n"] == seen["n"]:
        return packs
    drop_table(packs)
    each = term_counts(df, id_col, text).groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("c"))
    each = each.select("id", F.transform("c", lambda c: c["term"]).alias("terms"), F.transform("c", lambda c: c["tf"]).alias("counts"))
    return written(each.mapInArrow(pack, schema), "packs")


def term_buckets(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """``(id, vec)``: how many of an id's terms fall into each of ``n`` buckets, by the first four hex digits of a term's md5."""
    def count(batches):
        import hashlib

        import pyarrow as pa

        known: dict = {}
        for ids, sizes, flat in _in_parts(batches):
            coded = flat.dictionary_encode()
            terms = coded.dictionary.to_pylist()
            if len(known) > 500_000:
                known.clear()
            for t in terms:
                if t not in known:
                    known[t] = int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % n
            bucket = np.array([known[t] for t in terms], dtype=np.int64)
            at = np.repeat(np.arange(len(sizes)), sizes) * n + (bucket[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64))
            full = np.bincount(at, minlength=len(sizes) * n).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * n, pa.int32()), pa.array(full))
            have = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([ids.take(have), lists.take(have)], names=["id", "vec"])

    tokens = _tokens(df, id_col, text)
    schema = T.StructType([tokens.schema["id"], T.StructField("vec", T.ArrayType(T.DoubleType()))])
    rows = tokens.mapInArrow(count, schema)
    total = Summarizer.sum(array_to_vector("vec"))  # of the rows of an id
    return rows.groupBy("id").agg(vector_to_array(total).alias("vec"))


def tfidf_embed(df: DataFrame, id_col: str, text: str, max_features: int | None = None) -> DataFrame:
    """Sparse TF-IDF rows ``(id, term, w)`` with unit length; a text without terms has one row with a null term, weight 0.

    The vocabulary is whole unless ``max_features`` asks for the terms of highest corpus frequency (ties by term); texts
    without any of them keep their null row. idf = ln((1 + n) / (1 + df)) + 1. Texts are read once.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    each = df.select(F.col(id_col).alias("id"), F.explode_outer(F.coalesce(tokens, F.array().cast("array<string>"))).alias("term"))
    counts, seen = written_with(each.groupBy("id", "term").agg(F.count("term").alias("tf")), "terms", rows=F.count(F.lit(1)))
    ids = counts.select("id").distinct()
    n = ids.count() if seen["rows"] else 0
    vocab = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = vocab.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    raw = counts.where("term IS NOT NULL").join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    scaled = raw.select("id", "term", (F.col("w") / (length + F.lit(1e-12))).alias("w"))
    if max_features is None:
        none = counts.where("term IS NULL").join(counts.where("term IS NOT NULL").select("id"), "id", "left_anti").select("id")
    else:
        none = ids.join(raw.select("id"), "id", "left_anti")
    return scaled.unionByName(none.select("id", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("w")))


def sparse_to_dense(sparse: DataFrame) -> DataFrame:
    """``(id, vec)`` with one position per term in term order.

    Terms are numbered by a shuffle and a rank over the vocabulary; each vector is filled inside the engine, so neither the
    vocabulary nor a vector list passes through the driver. A dense vector is as long as the vocabulary: use it for
    limited ones.
    """
    terms = written(numbered(sparse.where("term IS NOT NULL").select("term").distinct(), "term", "i"), "numbered")
    size = terms.count()
    pairs = sparse.join(terms, "term", "left")
    packed = pairs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "w")))).alias("m"))
    zero = F.lit(0.0)
    vec = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.element_at("m", (i - 1).cast("long")), zero)) if size else F.array().cast("array<double>")
    return packed.select("id", vec.alias("vec"))


# ---- exact top-k cosine search -------------------------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _best(weights: np.ndarray, k: int):
    """Positions (row, col) of each row's k largest weights; equal weights prefer the smaller column."""
    k = min(k, weights.shape[1])
    floor = np.partition(weights, weights.shape[1] - k, axis=1)[:, weights.shape[1] - k]
    rows, cols = np.nonzero(weights >= floor[:, None])
    order = np.lexsort((cols, -weights[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(weights.shape[0]))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Rounding makes exact copies and mirrored products equal whatever the block shapes.
    return np.round(a @ b.T, 12)


def _copies(units: DataFrame, keep: int, by=()) -> DataFrame:
    """Distinct vectors with the smallest ids that carry them: ``(*by, first, ids, vec)``.

    Of a group of exact copies only the ``keep`` smallest ids can ever be among the nearest, ties being
    broken by id; so copies cost one vector each search, however many there are.
    """
    w = Window.partitionBy(*by, "vec").orderBy("id")
    few = units.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")
    grouped = few.groupBy(*by, "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select(*by, F.element_at("ids", 1).alias("first"), "ids", "vec")


def _packed(rows: DataFrame, keys, id_col: str, prefix: str) -> DataFrame:
    """One row per block: its ids in order and all its vectors in one flat array."""
    content = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), "vec")))  # at most block_rows or so
    return rows.groupBy(*keys).agg(content.alias("_c")).select(
        *keys, F.transform("_c", lambda c: c["id"]).alias(f"{prefix}_ids"),
        F.flatten(F.transform("_c", lambda c: c["vec"])).alias(f"{prefix}_flat"))


def _nearest(x: np.ndarray, floors: np.ndarray, mat: np.ndarray, rough: np.ndarray, place: np.ndarray, spans, k: int):
    """(row, col, weight) of each row's k best among the rows of ``mat`` in ``spans``, less those below the row's floor.

    ``rough`` is ``mat`` in single precision: its products say what can reach the k-th weight within their error bound, and
    only that is multiplied in double. Equal weights prefer the smaller ``place``.
    """
    margin = (x.shape[1] + 16) * 2.0 ** -23  # of products of unit vectors in single precision
    a, low = x.astype(np.float32), floors - 1e-11
    rows, cols, weights = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    step = max(k, 64, TILE // len(x))
    for lo, hi in spans:
        for at in range(lo, hi, step):
            w = a @ rough[at:min(at + step, hi)].T
            free = np.flatnonzero(low < -1) if w.shape[1] >= k else ()
            if len(free):  # no k-th weight yet: that of this tile is a bound
                low[free] = np.partition(w[free], w.shape[1] - k, axis=1)[:, w.shape[1] - k] - margin
            hit = np.flatnonzero(w >= (low - margin).astype(np.float32)[:, None])
            if not len(hit):
                continue
            r, c = np.divmod(hit, w.shape[1])
            # Rounding makes exact copies and mirrored products equal.
            exact = np.round(np.einsum("ij,ij->i", x[r], mat[at + c]), 12)
            rows, cols, weights = np.concatenate([rows, r]), np.concatenate([cols, at + c]), np.concatenate([weights, exact])
            order = np.lexsort((place[cols], -weights, rows))
            rank = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
            order, last = order[rank < k], order[rank == k - 1]
            low[rows[last]] = np.maximum(low[rows[last]], weights[last] - 1e-11)
            rows, cols, weights = rows[order], cols[order], weights[order]
    return rows, cols, weights


def _joined(spans):
    """Neighbouring spans as one."""
    out: list = []
    for lo, hi in sorted(spans):
        if out and out[-1][1] == lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return out


def _chunks(packs: DataFrame, keys, n_bytes: int, small_bytes: int) -> DataFrame:
    """Blocks dealt by hash to chunks of about ``small_bytes``."""
    return packs.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n_bytes // small_bytes)))).cast("int"))


def _met(blocks: DataFrame, packs: DataFrame, key: str, k: int, schema: T.StructType, keep: str) -> DataFrame:
    """k best right rows of every left row among the right blocks it meets.

    ``blocks(keep, a_ids, a_flat, wanted, floors)``: packed left rows, the keys of the right blocks that they meet, and the
    weight that a row's neighbours must reach, if known. ``packs(key, b_ids, b_flat)``: one chunk of packed right blocks, of
    checked bytes; it goes to all tasks.
    """
    spark = blocks.sparkSession
    got = packs.select(key, "b_ids", "b_flat").toArrow()
    ids = np.array([i for some in got["b_ids"].to_pylist() for i in some])
    if not len(ids):
        return None
    mat = got["b_flat"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    ends, spans = 0, {}
    for name, some in zip(got[key].to_pylist(), got["b_ids"].to_pylist()):
        spans.setdefault(name, []).append((ends, ends + len(some)))
        ends += len(some)
    sent = spark.sparkContext.broadcast((ids, mat, spans))

    def multiply(batches):
        ids, mat, spans = sent.value
        rough, place = mat.astype(np.float32), np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                left = np.asarray(row.a_ids)
                x = np.asarray(row.a_flat, dtype=np.float64).reshape(len(left), -1)
                known = row.floors is not None and len(row.floors) == len(left)
                floors = np.array(row.floors, dtype=np.float64) if known else np.full(len(left), -2.0)
                some = _joined(s for name in row.wanted for s in spans.get(name, ()))
                r, c, weight = _nearest(x, floors, mat, rough, place, some, k)
                if len(r):
                    yield pd.DataFrame({"src": left[r], "first": ids[c], "weight": weight, keep: getattr(row, keep)})[schema.names]

    out = written(blocks.select(keep, "a_ids", "a_flat", "wanted", "floors").mapInPandas(multiply, schema), "found")
    sent.destroy()
    return out


def _spread(blocks: DataFrame, n: int, *keys) -> DataFrame:
    """Blocks or pairs of them over enough tasks: a small table would else stay in a few partitions."""
    width = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(max(1, min(n, width)), *keys)


def all_pairs_topk(a: DataFrame, b: DataFrame, k: int, a_id: str = "id", a_vec: str = "vec", b_id: str = "id",
                   b_vec: str = "vec", exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
                   small_bytes: int = SMALL_BYTES, effort: list | None = None) -> DataFrame:
    """Exact k nearest rows of ``b`` by cosine for every row of ``a``: ``(src, dst, weight, rank)``.

    Order: weight descending (to 12 decimals), then the smaller id. With ``exclude_self`` a row is not its
    own neighbour.
    """
    left = with_unit(_evened(a.select(a_id, a_vec), a_id), a_id, a_vec)
    groups = k + 1 if exclude_self else k
    right = written(_copies(with_unit(b, b_id, b_vec), groups), "vectors")
    shape = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, dim = shape["n"], shape["d"] or 1
    schema = T.StructType([T.StructField("src", left.schema["id"].dataType),
                           T.StructField("first", right.schema["first"].dataType), T.StructField("weight", T.DoubleType())])
    carriers = right.select("first", "ids")
    if n <= block_rows and n * dim * 8 <= small_bytes:
        rows = right.select("first", "vec").toPandas().sort_values("first")  # size checked just above
        first, mat = rows["first"].to_numpy(), _matrix(rows["vec"]) if n else None

        def search(batches):
            for pdf in batches:
                for start in range(0, len(pdf) if n else 0, block_rows):
                    part = pdf.iloc[start:start + block_rows]
                    weights = _products(_matrix(part["vec"]), mat)
                    r, c = _best(weights, groups)
                    yield pd.DataFrame({"src": part["id"].to_numpy()[r], "first": first[c], "weight": weights[r, c]})

        return _ranked_pairs(left.mapInPandas(search, schema), F.broadcast(carriers), k, exclude_self)
    with Scope(a.sparkSession) as scope:
        top = Window.partitionBy("src").orderBy(F.desc("weight"), "first")
        found = _blocked(left, right, groups, n, block_rows, schema, effort, small_bytes)
        found = found.withColumn("_g", F.row_number().over(top)).filter(F.col("_g") <= groups).drop("_g")
        out = scope.keep(_ranked_pairs(found, carriers, k, exclude_self), "nearest")
    drop_table(right)
    return out


def _ranked_pairs(found: DataFrame, carriers: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k first pairs of each row, all ids of a vector standing for it."""
    pairs = found.join(carriers, "first").select("src", F.explode("ids").alias("dst"), "weight")
    if exclude_self:
        pairs = pairs.filter(F.col("src") != F.col("dst"))
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed_pivots(rows: DataFrame, open_nodes: DataFrame, branch: int, leaf_rows: int) -> DataFrame:
    """(node, pivots): up to ``branch`` rows of each open node, of smallest hash, their vectors in one flat array. A node that
    needs fewer leaves gets fewer, four for every ``leaf_rows`` of its rows."""
    some = first_n(rows.join(open_nodes, "node", "left_semi").select("node", F.xxhash64("first").alias("h"), "first", "vec"), ["node"], ["h", "first"], branch)
    content = F.array_sort(F.collect_list(F.struct("h", "first", "vec")))  # ``branch`` at most
    few = F.slice("_c", F.lit(1), F.least(F.lit(branch), F.ceil(F.col("n") * 4 / F.lit(leaf_rows))).cast("int"))
    packed = some.groupBy("node").agg(content.alias("_c")).join(open_nodes, "node")
    return packed.select("node", F.flatten(F.transform(few, lambda c: c["vec"])).alias("pivots"))


def _descended(rows: DataFrame, pivots: DataFrame, branch: int, chunks: int) -> DataFrame:
    """Rows of open nodes go to the child of the nearest pivot and note the angle to it; others stay as they are. Pivots go
    to the tasks in ``chunks`` parts, one after another."""
    names = rows.columns
    for chunk in range(chunks):
        got = pivots.where(F.pmod(F.xxhash64("node"), F.lit(chunks)) == chunk).toArrow()
        known = {node: np.asarray(flat) for node, flat in zip(got["node"].to_pylist(), got["pivots"].to_numpy())}

        def place(batches, known=known):
            for pdf in batches:
                for node, at in pdf.groupby("node").indices.items():
                    flat = known.get(node)
                    if flat is None:
                        continue
                    x = _matrix(pdf["vec"].iloc[at])
                    near = np.clip(x @ flat.reshape(-1, x.shape[1]).T, -1, 1)
                    child = near.argmax(axis=1)
                    pdf.iloc[at, pdf.columns.get_loc("node")] = node * branch + 1 + child
                    pdf.iloc[at, pdf.columns.get_loc("angle")] = np.arccos(near[np.arange(len(at)), child])
                yield pdf[names]

        rows = rows.mapInPandas(place, rows.schema)
    return rows


def ball_tree(left: DataFrame, right: DataFrame, leaf_rows: int, branch: int = BRANCH):
    """(left rows, right rows, nodes): a tree over ``right(first, vec)`` in tables, one level after another, that the rows of
    ``left(id, vec)`` descend as well.

    A node with more than ``leaf_rows`` right rows gets ``branch`` of them as pivots, and its rows go to the nearest; so
    there are about as many leaves as rows / leaf_rows, whatever the size. Rows have ``node`` (their leaf) and ``angle``
    (to its pivot). ``nodes(node, parent, center, radius, leaf)``: the radius covers all right rows below. A node whose rows
    all go to one child, as nearly equal vectors do, is not cut further.
    """
    start = [F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("angle")]
    a, b = left.select("*", *start), right.select("first", "vec", *start)
    shape = b.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    dim, levels = shape["d"], []
    open_nodes = written(b.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows), "open")
    while not open_nodes.isEmpty():
        pivots, seen = written_with(_packed_pivots(b, open_nodes, branch, leaf_rows), "pivots", items=F.sum(F.size("pivots")))
        before, chunks = (a, b), max(1, -(-8 * seen["items"] // SMALL_BYTES))
        a, b = written(_descended(a, pivots, branch, chunks), "left"), written(_descended(b, pivots, branch, chunks), "right")
        if levels:  # else what was given
            for table in before:
                drop_table(table)
        centers = pivots.withColumn("d", F.lit(dim)).select(
            F.col("node").alias("parent"), F.explode(F.sequence(F.lit(0), (F.size("pivots") / F.col("d")).cast("int") - 1)).alias("j"), "d", "pivots")
        centers = centers.select("parent", (F.col("parent") * branch + 1 + F.col("j")).alias("node"), F.slice("pivots", F.col("j") * F.col("d") + 1, F.col("d")).alias("center"))
        sizes = b.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        whole = open_nodes.select(F.col("node").alias("parent"), F.col("n").alias("whole"))
        # A pivot that all but equals another may stay without right rows; left rows may have come to it.
        level = centers.join(sizes, "node", "left").fillna({"n": 0, "radius": 0.0}).join(whole, "parent")
        level = written(level.withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("n") == F.col("whole"))), "level")
        levels.append(level.select("node", "parent", "center", "radius", "leaf"))
        open_nodes = written(level.where("NOT leaf").select("node", "n"), "open")
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return a, b, nodes, len(levels)


def _reached(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """Children of the nodes of ``frontier(ab, at, radius, floor, node)`` whose ball may hold a row within the floor, with the
    best possible weight; ``at`` and ``radius`` are the block's own ball."""
    child = F.array_sort(F.collect_list(F.struct("node", "center", "radius", "leaf")))  # ``branch`` at most
    packed = nodes.groupBy(F.col("parent").alias("node")).agg(child.alias("c")).select(
        "node", F.transform("c", lambda c: c["node"]).alias("ids"), F.flatten(F.transform("c", lambda c: c["center"])).alias("flat"),
        F.transform("c", lambda c: c["radius"]).alias("radii"), F.transform("c", lambda c: c["leaf"]).alias("leaves"))

    def bound(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                at = np.asarray(row.at, dtype=np.float64)
                gap = np.arccos(np.clip(np.asarray(row.flat, dtype=np.float64).reshape(-1, len(at)) @ at, -1, 1))
                best = np.cos(np.clip(gap - row.radius - np.asarray(row.radii) - SLACK, 0, np.pi))
                ok = best >= row.floor - SLACK
                leaf = np.asarray(row.leaves)[ok]  # leaves are not descended: no center with them
                out.append(pd.DataFrame({"ab": row.ab, "at": [None if x else row.at for x in leaf], "radius": row.radius, "floor": row.floor,
                                         "node": np.asarray(row.ids)[ok], "leaf": leaf, "bound": best[ok]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = "ab bigint, at array<double>, radius double, floor double, node bigint, leaf boolean, bound double"
    return frontier.join(packed, "node").select("ab", "at", "radius", "floor", "ids", "flat", "radii", "leaves").mapInPandas(bound, schema)


def _blocked(left: DataFrame, right: DataFrame, k: int, n: int, block_rows: int, schema: T.StructType, effort: list | None = None,
             small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Exact candidates by a ball tree: blocks of left rows of one leaf meet that leaf first, which gives a k-th weight; then
    they descend from the root past all balls that cannot reach it, meet the most promising leaves, and last those that
    the better k-th weight leaves. ``effort`` receives the number of row pairs compared."""
    a_rows, b_rows, nodes, depth = ball_tree(left, right, min(block_rows, max(1, n - 1)))

    def cut(rows, id_col, name):
        """Leaves in blocks of bounded size; a crowded leaf is spread over as many as it needs."""
        pieces = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("pieces"))
        piece = F.pmod(F.xxhash64(id_col, F.lit(7)), F.col("pieces"))
        dealt = join_per_key(rows, pieces, "node").withColumn("piece", piece).drop("pieces")
        return written(dealt.withColumn("block", F.xxhash64("node", "piece")), name)

    def packed(rows, id_col, block, prefix, name):
        """Packed blocks and their sizes; the rows themselves are not kept."""
        dealt = cut(rows, id_col, f"{name}-rows")
        meta = dealt.groupBy(F.col("block").alias(block), "node").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias(f"n_{prefix}"))
        meta = written(meta, f"{name}-blocks")
        packs = written(_packed(dealt.select(F.col("block").alias(block), id_col, "vec"), [block], id_col, prefix), f"{name}-packs")
        for table in (rows, dealt):
            drop_table(table)
        return meta, packs

    dim = right.agg(F.max(F.size("vec")).alias("d")).first()["d"]
    a_meta, a_pack = packed(a_rows, "id", "ab", "a", "left")
    b_meta, b_pack = packed(b_rows, "first", "bb", "b", "right")
    a_meta = written(a_meta.join(nodes.select("node", F.col("center").alias("at")), "node"), "left-blocks")
    n_blocks, chunks = a_meta.count(), max(1, -(-8 * n * dim // small_bytes))
    b_meta, b_pack = _chunks(b_meta, ["bb"], 8 * n * dim, small_bytes), _chunks(b_pack, ["bb"], 8 * n * dim, small_bytes)
    with_block = T.StructType(schema.fields + [T.StructField("ab", T.LongType())])
    found: list[DataFrame] = []

    def meet(pairs: DataFrame, name: str) -> None:
        """k best of every left row in the right blocks it meets, chunk by chunk."""
        pairs = pairs.join(a_meta.select("ab", "n_a"), "ab").join(b_meta.select("bb", "n_b", "chunk"), "bb")
        pairs, seen = written_with(pairs, name, n=F.count(F.lit(1)), rows=F.sum(F.col("n_a") * F.col("n_b")))
        if effort is not None:
            effort.append(seen["rows"] or 0)
        if not seen["n"]:
            return
        least = None
        if found:
            each = F.array_sort(F.collect_list(F.struct(F.col("src").alias("id"), "w")))  # in the order of a_ids
            least = written(kths().groupBy("ab").agg(each.alias("_f")).select("ab", F.transform("_f", lambda f: f["w"]).alias("floors")), "floors")
        for chunk in range(chunks):
            wanted = pairs.where(F.col("chunk") == chunk).groupBy("ab").agg(F.collect_list("bb").alias("wanted"))
            blocks = _spread(a_pack, n_blocks, "ab").join(wanted, "ab")
            blocks = blocks.join(least, "ab", "left") if least is not None else blocks.withColumn("floors", F.lit(None).cast("array<double>"))
            more = _met(blocks, b_pack.where(F.col("chunk") == chunk), "bb", k, with_block, "ab")
            if more is not None:
                found.append(more)

    def kths() -> DataFrame:
        """(ab, src, w): the k-th weight of every left row so far, -2 with fewer than k."""
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        top = Window.partitionBy("ab", "src").orderBy(F.desc("weight"))
        kth = every.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).groupBy("ab", "src").agg(F.count(F.lit(1)).alias("c"), F.min("weight").alias("w"))
        return kth.select("ab", "src", F.when(F.col("c") < k, F.lit(-2.0)).otherwise(F.col("w")).alias("w"))

    def floors() -> DataFrame:
        """(ab, floor): the smallest k-th weight among a block's rows."""
        return a_meta.select("ab").join(kths().groupBy("ab").agg(F.min("w").alias("floor")), "ab", "left").fillna({"floor": -2.0})

    # A leaf of nearly equal vectors may have many blocks: the first gives the k-th weight.
    home = b_meta.groupBy("node").agg(F.min("bb").alias("bb"))
    near = written(a_meta.select("ab", "node").join(home, "node").select("ab", "bb"), "home")
    meet(near, "home-pairs")
    frontier = a_meta.select("ab", "at", "radius").join(floors(), "ab").withColumn("node", F.lit(0).cast("long"))
    leaves = []
    for _ in range(depth):
        step = written(_reached(frontier, nodes), "reached")
        leaves.append(step.where("leaf").select("ab", "node", "bound"))
        frontier = step.where("NOT leaf").drop("leaf", "bound")
    targets = leaves[0]
    for more in leaves[1:]:
        targets = targets.unionByName(more)
    order = Window.partitionBy("ab").orderBy(F.desc("bound"), "node")
    targets = targets.join(b_meta.select("node", "bb"), "node").join(near, ["ab", "bb"], "left_anti")
    targets = written(targets.withColumn("r", F.row_number().over(order)), "targets")
    meet(targets.where(F.col("r") <= NEAREST).select("ab", "bb"), "next-pairs")
    rest = targets.where(F.col("r") > NEAREST).join(floors(), "ab").where(F.col("bound") >= F.col("floor") - SLACK)
    meet(rest.select("ab", "bb"), "last-pairs")
    out = found[0].select(*schema.names)
    for f in found[1:]:
        out = out.unionByName(f.select(*schema.names))
    return out


def knn_graph(df: DataFrame, id_col: str, vec: str, k: int, **blocks) -> DataFrame:
    """Directed edges ``(src, dst, weight)`` to the k nearest other rows, k at most n - 1."""
    return all_pairs_topk(df, df, k, id_col, vec, id_col, vec, exclude_self=True, **blocks).drop("rank")


def cosine_rows(a: DataFrame, b: DataFrame, a_id: str = "id", a_vec: str = "vec", b_id: str = "id",
                b_vec: str = "vec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dense similarity of two sets as matrix rows: ``(src, block, dst[], sims[])``.

    One output row holds the similarities of a left row to one block of right rows, so a row never grows
    with the right side and no pair table is shuffled.
    """
    left, right = with_unit(a, a_id, a_vec), with_unit(b, b_id, b_vec)
    n_a, n_b = left.count(), right.count()
    pa, pb = max(1, -(-n_a // block_rows)), max(1, -(-n_b // block_rows))
    a_pack = _packed(left.withColumn("ab", F.pmod(F.xxhash64("id"), F.lit(pa))), ["ab"], "id", "a")
    b_pack = _packed(right.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(pb))), ["bb"], "id", "b")
    pairs = a.sparkSession.range(pa * pb).select(F.floor(F.col("id") / pb).alias("ab"), (F.col("id") % pb).alias("bb"))
    blocks = _spread(pairs, pa * pb, "ab", "bb").join(a_pack, "ab").join(b_pack, "bb")
    schema = T.StructType([T.StructField("src", left.schema["id"].dataType), T.StructField("block", T.LongType()),
                           T.StructField("dst", T.ArrayType(right.schema["id"].dataType)),
                           T.StructField("sims", T.ArrayType(T.DoubleType()))])

    def multiply(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.a_flat, dtype=np.float64).reshape(len(row.a_ids), -1)
                y = np.asarray(row.b_flat, dtype=np.float64).reshape(len(row.b_ids), -1)
                yield pd.DataFrame({"src": row.a_ids, "block": int(row.bb), "dst": [row.b_ids] * len(x),
                                    "sims": list(_products(x, y))})

    return blocks.mapInPandas(multiply, schema)


def sparse_dots(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot products of sparse rows for the wanted ``pairs(src, dst)``; pairs without a shared term get 0.

    Terms are joined on (row, term), so a frequent term does not pair all its rows.
    """
    left = pairs.join(a.select(F.col("id").alias("src"), "term", F.col("w").alias("wa")), "src")
    right = b.select(F.col("id").alias("dst"), "term", F.col("w").alias("wb"))
    dots = left.join(right, ["dst", "term"]).groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return pairs.join(dots, ["src", "dst"], "left").select("src", "dst", F.coalesce("s", F.lit(0.0)).alias("weight"))


def topk_in_groups(a: DataFrame, b: DataFrame, k: int, group: str = "cohort", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every (group, left row) the k nearest right rows of the same group: ``(src, group, dst, weight, rank)``.

    ``a(group, id, vec)``, ``b(group, id, vec)``. Groups are cut into blocks of bounded size on both sides and
    only the k best of a block leave it, so a group may hold any share of the rows.
    """
    left = written(with_unit(_evened(a, "id"), "id", "vec", group), "asked")
    right = written(_copies(with_unit(_evened(b, "id"), "id", "vec", group), k, [group]), "members")

    def blocks_of(df, name):
        return df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias(name))

    sizes = written(blocks_of(left, "pa").join(blocks_of(right, "pb"), group), "sizes")

    def cut(df, id_col, pieces, block):
        known = join_per_key(df, sizes.select(group, pieces), group)
        return known.withColumn(block, F.pmod(F.xxhash64(id_col), F.col(pieces))).drop(pieces)

    # Explicit repartitioning: after a join by group all blocks of a group would be packed in one task.
    a_pack = written(_packed(cut(left, "id", "pa", "ab").repartition(group, "ab"), [group, "ab"], "id", "a"), "left-packs")
    b_pack = written(_packed(cut(right.select(group, "first", "vec"), "first", "pb", "bb").repartition(group, "bb"),
                             [group, "bb"], "first", "b"), "right-packs")
    drop_table(left)
    seen = b_pack.agg(F.sum(F.size("b_flat")).alias("items")).first()["items"] or 0
    n_blocks = a_pack.count()
    schema = T.StructType([T.StructField("src", left.schema["id"].dataType), left.schema[group],
                           T.StructField("first", right.schema["first"].dataType), T.StructField("weight", T.DoubleType())])
    packs, found = _chunks(b_pack, [group, "bb"], 8 * seen, SMALL_BYTES), None
    for chunk in range(max(1, -(-8 * seen // SMALL_BYTES))):
        part = packs.where(F.col("chunk") == chunk)
        blocks = _spread(a_pack, n_blocks, group, "ab").join(F.broadcast(part.select(group).distinct()), group, "left_semi")
        blocks = blocks.withColumn("wanted", F.array(group)).withColumn("floors", F.lit(None).cast("array<double>"))
        more = _met(blocks, part, group, k, schema, group)
        if more is not None:
            found = more if found is None else found.unionByName(more)
    for table in (a_pack, b_pack):
        drop_table(table)
    if found is None:
        found = left.sparkSession.createDataFrame([], schema)
    near = Window.partitionBy("src", group).orderBy(F.desc("weight"), "first")
    best = found.withColumn("_g", F.row_number().over(near)).filter(F.col("_g") <= k).drop("_g")
    w = Window.partitionBy("src", group).orderBy(F.desc("weight"), "dst")
    return (best.join(right.select(group, "first", "ids"), [group, "first"])
            .select("src", group, F.explode("ids").alias("dst"), "weight")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
