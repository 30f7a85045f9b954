"""Benchmark decontamination: SimHash of item-sized windows, Hamming search by blocks, exact weighted check.

Items and windows of documents have weighted five-word shingles: a shingle weighs its occurrences times
``ln(1 + items / items with it)``; shingles of no item weigh most. A window that shares no shingle with any item has
similarity 0 and needs no fingerprint, so documents are read once, as a stream of shingles, against the items' shingles;
wherever one is met, windows of the sizes of the items that hold it are laid so that it takes its place in them. Windows of
equal content are one from there on, and each gets a 64-bit SimHash, whichever item laid it.

The Hamming search is complete: two fingerprints at most ``RADIUS`` bits apart differ by ``RADIUS // 5`` bits or fewer in one
of five blocks, and the index holds every block of every item with all such changes. Candidates within the radius are
checked exactly: 100 * (sum of smaller weights) >= percent * (sum of larger weights). DataFrame functions only.

The item shingles are broadcast if their counted rows are at most ``MOST_BROADCAST``, else joined by shuffle.

A text of one to four words is one shingle, its whole sequence, and is compared with texts as short. Null and empty texts
have no shingles and match nothing. Equal documents match alike, equal items all match. Items without an id are ignored.
Other columns are ignored by :func:`hits` and kept by :func:`clean`. Empty tables give no hits.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from cohortflow.session import written

from .textkit import free_name

K, RADIUS, PERCENT = 5, 19, 80
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]  # first bit and width
MOST_BROADCAST = 1_000_000  # rows of three numbers
WINDOW = ["th", "start", "size"]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingled(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, pos, shingle) for each shingle of ``text``; pos counts from 0, n is the text's number of words."""
    blanks = F.lit(" \t\n\x0b\f\r")
    w = rows.select(key, F.split(F.trim(F.lower(F.coalesce("text", F.lit(""))), blanks), "[\\x20\\x09-\\x0D]+").alias("w"))
    w = w.where("w[0] <> ''").withColumn("n", F.size("w"))
    # Each word beside its followers, so that hashing is generated code over plain columns.
    beside = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.col("n") - K + 1, F.lit(1))).alias(f"w{i}") for i in range(K)])
    each = w.select(key, "n", F.posexplode(beside).alias("pos", "z"))
    return each.select(key, "n", "pos", F.xxhash64(*[F.col(f"z.w{i}") for i in range(K)]).alias("shingle"))


def weighted(grams: DataFrame, group: list[str], rarity: DataFrame, most: float) -> DataFrame:
    """(group, shingle, weight)."""
    counts = grams.groupBy(*group, "shingle").agg(F.count("*").alias("times"))
    return counts.join(rarity, "shingle", "left").select(*group, "shingle", (F.col("times") * F.coalesce("rarity", F.lit(most))).alias("weight"))


def fingerprints(weights: DataFrame, group: list[str]) -> DataFrame:
    """(group, print, total, content): SimHash, sum of weights, and a hash of the shingles and weights."""
    mixed = weights.withColumn("m", F.xxhash64("shingle", F.lit(7)))
    votes = [F.sum(F.when(F.getbit("m", F.lit(i)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"v{i}") for i in range(64)]
    bits = [F.when(F.col(f"v{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    sums = mixed.groupBy(*group).agg(*votes, F.sum("weight").alias("total"), F.bit_xor(F.xxhash64("shingle", "weight")).alias("content"))
    return sums.select(*group, reduce(Column.bitwiseOR, bits).alias("print"), "total", "content")


def block(bits: Column, i: int) -> Column:
    start, width = BLOCKS[i]
    return F.shiftrightunsigned(bits, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def index(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(block, value, item_id, item_print): each block of each item with all changes of ``radius // 5`` bits or fewer."""
    def part(i: int, width: int) -> DataFrame:
        masks = [sum(1 << b for b in c) for r in range(radius // len(BLOCKS) + 1) for c in combinations(range(width), r)]
        changed = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: block(F.col("item_print"), i).bitwiseXOR(m))
        return prints.select(F.lit(i).alias("block"), F.explode(changed).alias("value"), "item_id", "item_print")

    return reduce(DataFrame.unionByName, [part(i, width) for i, (_, width) in enumerate(BLOCKS)])


def within(prints: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (print, item_id) whose fingerprints are at most ``radius`` bits apart."""
    blocks = prints.select("print").distinct().select("print", F.posexplode(F.array(*[block(F.col("print"), i) for i in range(len(BLOCKS))])).alias("block", "value"))
    near = blocks.join(index(items, radius), ["block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    return near.select("print", "item_id").distinct()


def hits(docs: DataFrame, items: DataFrame, percent: int = PERCENT, radius: int = RADIUS, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(th, item_id, start, n_words, similarity): texts, by key, with a window that matches an item; the best window of each
    pair, the first of equals; start counts words from 0."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL")
    item_grams = written(shingled(items, "item_id"), "item-shingles")
    n_items = float(item_grams.select("item_id").distinct().count())
    rarity = item_grams.groupBy("shingle").agg(F.countDistinct("item_id").alias("df")).select("shingle", F.log(1 + F.lit(n_items) / F.col("df")).alias("rarity"))
    rarity = written(rarity, "rarity")
    most = math.log(1 + n_items)
    item_weights = written(weighted(item_grams, ["item_id"], rarity, most), "item-weights")
    prints = written(fingerprints(item_weights, ["item_id"]).select("item_id", F.col("print").alias("item_print"), F.col("total").alias("item_total")), "item-prints")

    layout = written(item_grams.select("shingle", F.col("n").alias("size"), F.col("pos").alias("inside")).distinct(), "layout")
    if layout.count() <= MOST_BROADCAST:
        layout = F.broadcast(layout)
    texts = docs.select(text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    met = shingled(texts, "th").join(layout, "shingle").where((F.col("n") >= K) == (F.col("size") >= K))
    start = F.greatest(F.least(F.col("pos") - F.col("inside"), F.col("n") - F.col("size")), F.lit(0))
    windows = written(met.select("th", start.alias("start"), "size", "n").distinct(), "windows")

    held = texts.join(windows.select("th").distinct().hint("merge"), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    grams = shingled(held, "th").select("th", "pos", "shingle")
    last = F.greatest(F.least(F.col("start") + F.col("size"), F.col("n")) - K, F.col("start"))
    inside = windows.select(*WINDOW, F.explode(F.sequence("start", last)).alias("pos")).join(grams, ["th", "pos"])
    weights = written(weighted(inside, WINDOW, rarity, most), "window-weights")
    marks = written(fingerprints(weights, WINDOW), "window-prints")

    # One window stands for all of equal content.
    contents = marks.groupBy("content").agg(F.min(F.struct(*WINDOW)).alias("w"), F.first("print").alias("print"), F.first("total").alias("total"))
    contents = written(contents.select("content", "w.*", "print", "total"), "contents")
    pairs = contents.join(within(contents, prints, radius), "print").select("content", *WINDOW, "total", "item_id")
    shared = pairs.join(weights, WINDOW).withColumnRenamed("weight", "w1").join(item_weights.withColumnRenamed("weight", "w2"), ["item_id", "shingle"])
    common = shared.groupBy("content", "item_id").agg(F.sum(F.least("w1", "w2")).alias("common"), F.first("total").alias("total"))
    similar = common.join(prints, "item_id").withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")))
    similar = written(similar.where(F.col("similarity") * 100 >= percent - 1e-9).select("content", "item_id", "similarity"), "similar")
    found = marks.join(similar, "content").join(windows, WINDOW)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.least("size", "n").alias("n_words"))).alias("b")
    return found.groupBy("th", "item_id").agg(best).select("th", "item_id", (-F.col("b.back")).alias("start"), "b.n_words", "b.similarity")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) of every document and item that match."""
    found = written(hits(docs, items, text_col=text_col, **options), "hits")
    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("th")).join(found, "th").drop("th")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, whose text matches no item."""
    key = free_name(docs.columns, "__th")
    found = written(hits(docs, items, text_col=text_col, **options).select(F.col("th").alias(key)).distinct(), "hits")
    return docs.join(found, text_key(F.col(text_col)) == F.col(key), "left_anti")
