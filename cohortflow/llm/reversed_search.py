"""Ranked lexical search, reversed: the stated items are the index, and the documents stream through it.

1. The items' terms become an inverted index (term -> items and repeats), broadcast. A block of the index holds about
   500,000 postings and at most 4,096 items on average (its items are dealt by hash); more items make more blocks, each
   of which the documents pass.
2. One pass cuts each document into terms, counts all of them and keeps, in a written table, how often it has those of the
   index. The number of documents, their terms and each indexed term's document frequency come from that table.
3. That table streams through the index: a task keeps a heap of the ``best`` highest-scoring documents for each item, as
   arrays, and only what reaches an item's lowest kept score is merged into it. Heaps leave the tasks as rows and are
   merged in two steps, first in 256 groups of tasks, so no task ever meets all heaps of an item of a large table.

A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``; all else is 64-bit integers, so results are equal
whatever the partitioning. No document is skipped: the work is documents times the items that share a term.

A null, empty or term-less document has no score; an item without terms, and an item that no document scores for, has no
rows. Repeated document rows are ranked each, equal scores by ascending id, null ids last. Equal item rows are one item;
rows of one id with different texts are searched each. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cohortflow.session import Scope, written, written_with

from .textkit import arrow_batch

BEST, POSTINGS, ITEMS = 10, 500_000, 4096
PIECE = 1 << 20  # bytes of a text that are cut into terms at once
CELLS = 1 << 20  # scores of documents by items held at once
GROUPS = 256
# Every byte that no term holds becomes a space, A-Z become a-z; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
ITEM_TERMS = "item_id long, item string, term binary, repeats long"
MATCHED = "doc_id long, n long, term array<int>, tf array<long>"
HEAPS = "item int, item_id long, doc_id long, score long, part int"


def terms(text: bytes):
    """Lists of the terms of a UTF-8 text, for some piece of it after another."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item, term, repeats); ``item`` tells apart the texts of one id."""

    def run(batches):
        for batch in batches:
            out = []
            for item_id, item, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = Counter(t for piece in terms(text) for t in piece)
                out += [(item_id, item, t, n) for t, n in counts.items()]
            yield arrow_batch(ITEM_TERMS, zip(*out) if out else [[]] * 4)

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return rows.select("item_id", F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text"), 256).alias("item"),
                       F.encode("text", "UTF-8").alias("text")).mapInArrow(run, ITEM_TERMS)


class Index:
    """Postings of one block of items: ``postings[term number] = (items, repeats)``, numbers dense from 0."""

    def __init__(self, rows: list):
        self.number: dict[bytes, int] = {}
        place: dict[str, int] = {}
        ids, postings = [], []
        for r in rows:
            if r["item"] not in place:
                place[r["item"]] = len(ids)
                ids.append(r["item_id"])
            t = self.number.setdefault(bytes(r["term"]), len(postings))
            if t == len(postings):
                postings.append(([], []))
            postings[t][0].append(place[r["item"]])
            postings[t][1].append(r["repeats"])
        self.ids = ids
        self.postings = [(np.array(i, np.int64), np.array(n, np.int64)) for i, n in postings]


def matched(docs: DataFrame, numbers, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term, tf): all terms of each document counted, and those of the broadcast ``numbers`` told apart."""

    def run(batches):
        import pyarrow as pa

        known = numbers.value
        for batch in batches:
            n, sizes, found, tf = [], [0], [], []
            for text in batch.column(1):
                total, counts = 0, Counter()
                for piece in terms(text.as_py()):
                    total += len(piece)
                    counts.update(filter(known.__contains__, piece))
                n.append(total)
                sizes.append(sizes[-1] + len(counts))
                found += map(known.__getitem__, counts)
                tf += counts.values()
            ends = pa.array(sizes, pa.int32())
            yield arrow_batch(MATCHED, [batch.column(0), n, pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                                        pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    return rows.mapInArrow(run, MATCHED)


def document_scores(n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, postings: list,
                    items: int, docs: int, all_terms: int) -> np.ndarray:
    """Scores (documents x items) of documents with ``sizes`` matched terms each, laid end to end."""
    m = 25 + 75 * n * docs // all_terms
    row = np.repeat(np.arange(len(n)), sizes)
    gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    out = np.zeros((len(n), items), np.int64)
    order = np.argsort(term, kind="stable")
    cuts = np.flatnonzero(np.diff(term[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        which, repeats = postings[term[at[0]]]
        out[np.ix_(row[at], which)] += gain[at, None] * repeats
    return out


class Heaps:
    """The ``best`` highest-scoring documents of each item seen so far: score down, id up, null ids last."""

    def __init__(self, items: int, best: int):
        self.best, self.items = best, items
        self.low = np.ones(items, np.int64)  # a score below cannot enter
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        low = self.low
        if len(scores) > self.best:
            low = np.maximum(low, np.partition(scores, len(scores) - self.best, axis=0)[len(scores) - self.best])
        row, item = np.nonzero(scores >= low)
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        doc, null = np.concatenate([self.doc, doc[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[order], np.arange(self.items))
        kept = order[np.arange(len(order)) - first[item[order]] < self.best]
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        full = np.bincount(self.item, minlength=self.items) == self.best
        ends = np.searchsorted(self.item, np.arange(self.items), "right") - 1
        self.low[full] = self.score[ends[full]]


def heaps(found: DataFrame, index, weight: np.ndarray, docs: int, all_terms: int, best: int) -> DataFrame:
    """(item, item_id, doc_id, score, part): each task's heaps of the broadcast ``index`` over the table of :func:`matched`."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        postings, ids = index.value
        kept = Heaps(len(ids), best)
        step = max(1, CELLS // len(ids))
        for batch in batches:
            doc, null = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n, sizes = batch.column(1).to_numpy(), pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for lo in range(0, len(n), step):
                hi = min(lo + step, len(n))
                at = slice(ends[lo], ends[hi])
                kept.add(document_scores(n[lo:hi], sizes[lo:hi], term[at], tf[at], weight, postings, len(ids), docs, all_terms), doc[lo:hi], null[lo:hi])
        out = pa.array(ids, pa.int64()).take(pa.array(kept.item))
        yield arrow_batch(HEAPS, [kept.item, out, pa.array(kept.doc, mask=kept.null), kept.score, np.full(len(kept.item), TaskContext.get().partitionId())])

    return found.mapInArrow(run, HEAPS)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", postings: int = POSTINGS, block_items: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``best`` documents of highest positive score."""
    spark = docs.sparkSession
    with Scope(spark) as scope:
        asked, seen = written_with(item_terms(items, item_id, item_text), "item-terms", n=F.count(F.lit(1)), items=F.approx_count_distinct("item"))
        blocks = max(1, -(-seen["n"] // postings), -(-seen["items"] // block_items))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        totals, parts = None, []
        for block in range(blocks):
            index = Index(asked.where(F.col("block") == block).select("item_id", "item", "term", "repeats").collect())  # about ``postings`` rows
            if not index.ids:
                continue
            numbers = spark.sparkContext.broadcast(index.number)
            found, totals = written_with(matched(docs, numbers, doc_id, doc_text), "matched", docs=F.count_if(F.col("n") > 0), terms=F.sum("n"))
            if not totals["docs"]:
                break
            held = np.zeros(len(index.postings))
            for r in found.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # one row for each term of the block
                held[r["t"]] = r["count"]
            weight = np.array([math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
            lists = spark.sparkContext.broadcast((index.postings, index.ids))
            part = heaps(found, lists, weight, totals["docs"], totals["terms"], best).withColumn("block", F.lit(block))
            parts.append(written(part, "heaps"))
        if not parts:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = every.withColumn("group", F.pmod("part", F.lit(GROUPS)))
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("block", "item", "group").orderBy(*order))).where(F.col("r") <= best)
        rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))
        top = some.withColumn("rank", rank).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
        return scope.keep(top, "ranked")
