"""Near duplicates by an LSH forest: sorted signature orders, neighbours with the longest common prefix, exact checks.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Texts with equal sets are one *node*; the other
   steps see nodes only, so copies cost nothing more.
2. A node gets ``trees * depth`` min-hashes. In each tree the nodes are sorted by their ``depth`` values. A region
   is a run with a common prefix of ``least`` values; one of at most ``crowd`` nodes is compared as a whole. In a larger
   region, or one that lies over an end of a partition, a node is compared with the neighbours of longest prefix, ``reach``
   on either side: there the depth adapts, and a node has few pairs whatever the region's size. What these leave apart
   is compared with the whole region at the end, in blocks, so no pair of a region is lost.
3. A neighbour is a candidate if one-byte sketches of all min-hashes promise it (0.15 below the threshold, more than four
   deviations). Candidates are checked in rounds: each node's best one first, then 4, 16, ... more. A round confirms on
   full sets and unites. Candidates inside one component need no more checks, so a crowd of copies costs a few checks a
   node. Rounds end when no candidate is left.

No step gathers a group: orders are range partitions with the node itself as last key, tasks unite a bounded number of links
between components, and smallest labels spread over what several tasks found. Stages are written to the shared folder, so a lost executor repeats only its part.

Nulls, empty texts and texts without words have no set and are alone. A null id is never a component's smallest; a group
of null ids only has a null component. Repeated rows fall into one node. A component is told apart by its smallest
(id, node), not by the id: texts that share an id, or have none, are linked only if their sets are. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortflow.session import written, written_with

from .textkit import SHINGLE, Hasher, arrow_batch, distinct_shingles, free_name, mix

TREES, DEPTH, LEAST, REACH, CROWD = 16, 8, 3, 2, 5
LINKS = 1 << 18  # that a task unites
SIGNED = "doc_id long, n_shingles long, node long, keys binary, sketch binary"


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def min_hashes(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), ~np.uint64(0), np.uint64)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (a[:, None] * x[None, lo:lo + 2048]).min(axis=1), out=out)
    return mix(out)


def node_of(x: np.ndarray) -> int | None:
    """Hash of a set; none for an empty one."""
    return int(mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(x))])).astype(np.int64)[0]) if len(x) else None


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
               trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, node, keys, sketch): the set's size and hash; ``keys`` has 2 bytes a value, tree by tree."""

    def run(batches):
        hasher, a = Hasher(), multipliers(trees * depth)
        for batch in batches:
            n, node, keys, sketch = [], [], [], []
            for x in distinct_shingles(batch.column(1).to_pylist(), hasher, k):
                n.append(len(x))
                node.append(node_of(x))
                h = min_hashes(x, a) if len(x) else np.zeros(0, np.uint64)
                keys.append((h & np.uint64(0xFFFF)).astype(">u2").tobytes())
                sketch.append((h >> np.uint64(56)).astype(np.uint8).tobytes())
            yield arrow_batch(SIGNED, [batch.column(0), n, node, keys, sketch])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SIGNED)


def neighbours(nodes: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, reach: int = REACH,
               crowd: int = CROWD, promise: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, score), a < b, the score being the prefixes they share, summed over all trees; and the nodes
    (node, region) of regions that are too crowded to be compared as a whole."""
    spark = nodes.sparkSession
    keys = nodes.select("node", "sketch", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                        lambda t: F.substring(F.col("keys"), t * (2 * depth) + 1, F.lit(2 * depth)))).alias("tree", "key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def runs(tree, key):
        """Values as rows, and the run of each row: neighbours that share ``least`` values or more."""
        vals = np.frombuffer(b"".join(key), ">u2").reshape(len(key), depth)
        apart = (tree[1:] != tree[:-1]) | (vals[1:, :least] != vals[:-1, :least]).any(axis=1)
        return vals, np.concatenate([[0], np.cumsum(apart)])

    def region(tree, vals):
        """Number of a row's region, from its tree and prefix."""
        out = mix(tree.astype(np.uint64) + np.uint64(1))
        for i in range(least):
            out = mix(out ^ vals[:, i].astype(np.uint64))
        return out.astype(np.int64)

    def near(vals, run, crowded, node, sketch, before, after):
        """Pairs of a run whose sketches promise ``promise`` or more, the first ahead of position ``before``, the second from
        ``after`` on; in a crowded run at most ``reach`` apart in the order."""
        bits = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1)
        step, at = 1, np.arange(len(node))
        while True:
            at = at[at + step < len(node)]
            at = at[(run[at] == run[at + step]) & ((step <= reach) | ~crowded[at])]
            if not len(at):
                return
            i = at[(at < before) & (at + step >= after)]
            i = i[likeness(bits[i], bits[i + step]) >= promise]
            if len(i):
                lcp = np.cumprod(vals[i] == vals[i + step], axis=1).sum(axis=1)
                x, y = node[i], node[i + step]
                yield np.minimum(x, y), np.maximum(x, y), lcp
            step += 1

    def scan(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, head, held, size, done = TaskContext.get().partitionId(), None, None, 0, 0

        def pairs(pdf, last):
            """Pairs of complete and of crowded runs. ``held`` becomes what later rows may pair with: the last run, or
            the end of it if it is crowded; ``size`` counts that run, ``done`` its rows already paired with each other."""
            nonlocal held, size, done
            node = pdf["node"].to_numpy()
            vals, run = runs(pdf["tree"].to_numpy(), pdf["key"].tolist())
            sizes = np.bincount(run)
            sizes[0] += max(size - (0 if held is None else len(held)), 0)
            crowded = sizes[run] > crowd
            first = int(np.searchsorted(run, run[-1]))
            open_ = not last and not crowded[-1]
            stop = first if open_ else len(node)
            for a, b, s in near(vals[:stop], run[:stop], crowded[:stop], node[:stop], pdf["sketch"].tolist()[:stop], stop, done):
                yield pd.DataFrame({"a": a, "b": b, "score": s, "part": -1, "tree": 0, "key": None, "sketch": None, "pos": 0})
            new = np.flatnonzero(crowded[done:stop]) + done
            yield pd.DataFrame({"a": node[new], "b": region(pdf["tree"].to_numpy()[new], vals[new]), "score": 0, "part": -2, "tree": 0, "key": None, "sketch": None, "pos": 0})
            size = int(sizes[-1])
            held = pdf.iloc[first:] if open_ else pdf.iloc[max(first, len(pdf) - reach):]
            done = 0 if open_ else len(held)

        tail = None
        for pdf in batches:
            if not len(pdf):
                continue
            head = pdf.head(crowd) if head is None else head if len(head) == crowd else pd.concat([head, pdf]).head(crowd)
            tail = (pdf if tail is None else pd.concat([tail, pdf])).tail(crowd)
            yield from pairs(pdf if held is None else pd.concat([held, pdf], ignore_index=True), False)
        if held is not None and not done:
            yield from pairs(held.reset_index(drop=True), True)
        if tail is not None:  # the ends of this partition meet those of the next
            for rows, at, pos in ((tail, part, np.arange(len(tail)) - len(tail)), (head, part - 1, np.arange(len(head)))):
                yield pd.DataFrame({"a": rows["node"].to_numpy(), "b": rows["node"].to_numpy(), "score": 0, "part": at, "tree": rows["tree"].to_numpy(), "key": rows["key"].tolist(), "sketch": rows["sketch"].tolist(), "pos": pos})

    found = written(ordered.mapInPandas(scan, "a long, b long, score long, part int, tree int, key binary, sketch binary, pos int"), "forest-pairs")

    def meet(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        vals, run = runs(pdf["tree"].to_numpy(), pdf["key"].tolist())
        cut, node, crowded = int((pdf["pos"] < 0).sum()), pdf["a"].to_numpy(), np.bincount(run)[run] > crowd
        # A region may go on in more partitions than these two: it counts as crowded, so its strays are looked for.
        got = list(near(vals, run, crowded, node, pdf["sketch"].tolist(), cut, cut))
        a, b, s = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in range(3))
        at = np.flatnonzero(np.isin(run, np.intersect1d(run[:cut], run[cut:])))
        over = pd.DataFrame({"a": node[at], "b": region(pdf["tree"].to_numpy()[at], vals[at]), "score": 0, "part": -2})
        return pd.concat([pd.DataFrame({"a": a, "b": b, "score": s, "part": -1}), over])

    over = written(found.where("part >= 0").groupBy("part").applyInPandas(meet, "a long, b long, score long, part int"), "forest-edges")
    all_ = found.where("part < 0").select("a", "b", "score", "part").unionByName(over)
    pairs = all_.where("part = -1 AND a <> b").groupBy("a", "b").agg(F.sum("score").alias("score"))
    return pairs, all_.where("part = -2").select(F.col("a").alias("node"), F.col("b").alias("region")).distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(node, full): sorted shingle hashes of each wanted (doc_id, node). A repeated id is told apart by its node."""

    def run(batches):
        import pandas as pd

        hasher = Hasher()
        for pdf in batches:
            node, full = [], []
            for x in distinct_shingles(pdf["text"].tolist(), hasher, k):
                if len(x):  # a null among them would make the hashes floats
                    node.append(node_of(x))
                    full.append(x.tobytes())
            yield pd.DataFrame({"node": np.array(node, np.int64), "full": full})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = wanted.select("doc_id").distinct()
    sets = texts.join(ids.hint("merge"), texts.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text").mapInPandas(run, "node long, full binary")
    return sets.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("full").alias("full"))


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of sets as their sketches (last axis) tell it, by chance agreements corrected."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    a, b = (sets.select(F.col("node").alias(x), F.col("full").alias(f"full_{x}")) for x in "ab")

    def run(batches):
        for pdf in batches:
            good = [enough(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), percent) for u, v in zip(pdf["full_a"], pdf["full_b"])]
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").select("a", "b", "full_a", "full_b").mapInPandas(run, "a long, b long")


def strays(crowds: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, floor: float, block: int = 512) -> DataFrame:
    """Links (a, b) in crowded regions between nodes of different components, all that there are.

    In each region the nodes outside its largest component are a query set against all of its nodes, in blocks of both;
    blocks meet in tasks of bounded size, sketches sort out the unlikely, and only links leave a task (one for each query
    and component). A region that is one component already costs nothing.
    """
    member = written(crowds.join(labels.select("node", F.col("label.node").alias("label")), "node"), "crowd")
    sizes = member.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("region").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    dealt = member.join(shape, "region").select(
        "region", "node", "label", (F.col("label") != F.col("main.label")).alias("asks"), F.ceil(F.col("total") / block).cast("int").alias("nb"),
        F.ceil((F.col("total") - F.col("main.n")) / block).cast("int").alias("nq"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = dealt.select("region", "node", "label", F.lit(False).alias("asks"), own("nb").alias("bb"), each("nq").alias("qb"))
    asks = dealt.where("asks").select("region", "node", "label", F.lit(True).alias("asks"), own("nq").alias("qb"), each("nb").alias("bb"))
    rows = base.unionByName(asks).join(nodes.select("node", "sketch"), "node").join(sets, "node")

    def compare(pdf):
        import pandas as pd

        base, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        links = []
        if len(base) and len(asking):
            sketch, label, node = np.stack([np.frombuffer(x, np.uint8) for x in base["sketch"]]), base["label"].to_numpy(), base["node"].to_numpy()
            full = [np.frombuffer(x, np.uint64) for x in base["full"]]
            for v, lab, sk, raw in zip(asking["node"], asking["label"], asking["sketch"], asking["full"]):
                alike = likeness(sketch, np.frombuffer(sk, np.uint8))
                x, seen = np.frombuffer(raw, np.uint64), {lab}
                for i in np.flatnonzero(alike >= percent / 100 - floor).tolist():
                    if label[i] not in seen and enough(x, full[i], percent):
                        seen.add(label[i])
                        links.append((min(v, node[i]), max(v, node[i])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("region", "bb", "qb").applyInPandas(compare, "a long, b long").distinct()


def enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def merged(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that links (x, y) join each of 0 to n - 1 with."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def united(labels: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """(node, label): each label becomes the smallest one that ``links`` (a, b) join it with.

    Links become links of labels, and tasks unite ``most`` of them each. What several tasks found is united by :func:`spread`.
    """
    one, two = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    ends = [F.col(f"label_{x}.{f}").alias(f"{f}_{x}") for x in "ab" for f in ("no_id", "id", "node")]
    between, seen = written_with(links.join(one, "a").join(two, "b").where("label_a <> label_b").select(*ends), "between", n=F.count(F.lit(1)))
    if not seen["n"]:
        return labels
    tasks = -(-seen["n"] // most)

    def run(batches):
        import pandas as pd

        pdf = pd.concat(batches, ignore_index=True) if (batches := list(batches)) else None
        if pdf is None or not len(pdf):
            return
        no, id_, node = (np.concatenate([pdf[f"{f}_{x}"].to_numpy() for x in "ab"]) for f in ("no_id", "id", "node"))
        order = np.lexsort((node, id_, no))
        fresh = np.concatenate([[True], node[order][1:] != node[order][:-1]])  # a node has one id
        at, code = order[fresh], np.empty(len(node), np.int64)
        code[order] = np.cumsum(fresh) - 1
        to = at[merged(code[:len(pdf)], code[len(pdf):], len(at))]
        yield pd.DataFrame({f"{f}_{x}": v[i] for x, i in (("a", at), ("b", to)) for f, v in (("no_id", no), ("id", id_), ("node", node))})

    found = written(between.repartition(tasks).mapInPandas(run, between.schema), "united")
    old, now = (F.struct(*[F.col(f"{f}_{x}").alias(f) for f in ("no_id", "id", "node")]) for x in "ab")
    if tasks == 1:
        found = found.select(F.col("node_a").alias("old"), now.alias("now"))
    else:
        own = written(found.select(old.alias("label")).unionByName(found.select(now.alias("label"))).distinct().select(F.col("label.node").alias("node"), "label"), "labels")
        found = spread(own, found.where("node_a <> node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).select(F.col("node").alias("old"), F.col("label").alias("now"))
    after = labels.join(found, F.col("label.node") == F.col("old"), "left")
    return written(after.select("node", F.coalesce("now", "label").alias("label")), "labels")


def spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after spreading the smallest label over links, and from each label's own node to its followers."""
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), F.col("label").alias("seen")), "y").groupBy(F.col("x").alias("node")).agg(F.min("seen").alias("seen"))
        moved = written(labels.join(near, "node", "left").select("node", "label", F.least("label", "seen").alias("now")), "labels")
        changed = moved.where("now < label")
        if changed.isEmpty():
            return labels
        # A label that was itself united with a smaller one takes all nodes that still carry it along.
        jump = changed.groupBy("label").agg(F.min("now").alias("to"))
        after = moved.join(jump.withColumnRenamed("label", "old"), moved.label == F.col("old"), "left")
        labels = written(after.select("node", F.least("now", "to").alias("label")), "labels")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = SHINGLE,
             floor: float = 0.15, **forest) -> DataFrame:
    """(doc_id, n_shingles, node, label) of every row of ``docs``; ``label``: (no_id, id, node) of its component's first node, null
    for a row without a set. ``floor``: how far below ``percent`` a sketch may say."""
    rows = written(signatures(docs, id_col, text_col, k), "signatures")
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    pairs, crowds = neighbours(nodes, promise=percent / 100 - floor, **forest)
    pairs, crowds = written(pairs, "candidates"), written(crowds, "crowds")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node")).distinct()
    wanted = written(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "sketch"), "in-pairs")
    sets = written(full_sets(docs, wanted, id_col, text_col, k), "sets")
    # Nodes without an id sort last. The node itself is part of a label: others may have the same id, or none.
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("node").alias("node"))
    labels = written(wanted.select("node", own.alias("label")), "labels")
    best = 1
    while not pairs.isEmpty():
        ends = pairs.select(F.col("a").alias("node"), "score", "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "score", "a", "b"))
        top = F.slice(F.sort_array(F.collect_list(F.struct("score", "a", "b")), False), 1, best)  # a node has at most 2 * reach * trees pairs
        now = written(ends.groupBy("node").agg(top.alias("top")).select(F.explode("top").alias("p")).select("p.a", "p.b").distinct(), "round")
        links = written(confirmed(now, sets, percent), "links")
        labels = united(labels, links)
        rest = pairs.join(now, ["a", "b"], "left_anti")
        one, two = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        pairs = written(rest.join(one, "a").join(two, "b").where("label_a <> label_b").select("a", "b", "score"), "candidates")
        best *= 4
    if not crowds.isEmpty():
        labels = united(labels, written(strays(crowds, wanted, sets, labels, percent, floor), "links"))
    labels = nodes.select("node", own.alias("own")).join(labels, "node", "left").select("node", F.coalesce("label", "own").alias("label"))
    return rows.select("doc_id", "n_shingles", "node").join(written(labels, "components"), "node", "left").select("doc_id", "n_shingles", "node", "label")


def components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; options as of :func:`labelled`."""
    id_ = F.when(F.col("node").isNull(), F.col("doc_id")).when(~F.col("label.no_id"), F.col("label.id"))
    return labelled(docs, **options).select("doc_id", "n_shingles", id_.alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """:func:`components` with ``kept``: the row has its component's smallest id (rows of null ids only are kept)."""
    return components(docs, **options).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def with_node(docs: DataFrame, text_col: str = "text", k: int = SHINGLE, name: str = "node") -> DataFrame:
    """``docs`` with the column ``name``, the hash of the text's set."""
    at, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            node = pa.array([node_of(x) for x in distinct_shingles(texts, hasher, k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that stay: of each component one row of its first node with its smallest id; and every row
    without a set. A row is known by its id and its node, so rows with a null or repeated id are decided each for itself."""
    rows = labelled(docs, id_col=id_col, text_col=text_col, k=k, **options)
    first = (F.col("node") == F.col("label.node")) & F.col("doc_id").eqNullSafe(F.when(~F.col("label.no_id"), F.col("label.id")))
    one, node, its = (free_name(docs.columns, x) for x in ("__id", "__node", "__its"))
    rows = written(rows.select(F.col("doc_id").alias(one), F.col("node").alias(node), (F.col("node").isNull() | first).alias("stays")), "kept")
    ids = rows.where(F.col(one).isNotNull()).groupBy(one).agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("stays")).where("stays")
    ids = written(ids, "kept-ids")
    of_id = docs[id_col].cast("long")
    sole, many = ids.where("n = 1").select(one), ids.where("n > 1").select(one)
    stay = docs.join(sole.hint("merge"), of_id == F.col(one), "left_semi")
    named = rows.where(F.col(one).isNull()).isEmpty(), many.isEmpty()
    if all(named):
        return stay
    # Ids that do not name one row: here a row is looked up by its set as well.
    rest = docs.where(of_id.isNull()) if named[1] else docs.join(many.hint("merge"), of_id == F.col(one), "left_semi").unionByName(docs.where(of_id.isNull()))
    rest = with_node(rest, text_col, k, node)
    wanted = rows.where(F.col("stays") & F.col(node).isNotNull()).select(one, F.col(node).alias(its)).distinct()
    found = rest.join(wanted, (F.col(node) == F.col(its)) & rest[id_col].cast("long").eqNullSafe(F.col(one)), "left_semi")
    return stay.unionByName(found.dropDuplicates([id_col, node]).drop(node)).unionByName(rest.where(F.col(node).isNull()).drop(node))
