"""Spelling variants by k-d trees over letter-count vectors.

1. Words are counted in tasks over whole texts and summed by word. Some runs lose a letter first, by the rule of
   :func:`word_counts` (planted misspellings that are the same on every run).
2. One edit changes a letter-count vector by at most two: a replaced letter takes one count and adds another, an inserted
   letter adds one. So words of one length are near only if their vectors differ by one up and one down, words of lengths
   L and L + 1 only by one up. For each length a k-d tree of splits ``count of a letter >= t`` is learned from a sample of
   words in hash order (``SAMPLE`` at most, which decides balance only, never a result), with a leaf for about ``LEAF``
   words of the whole vocabulary.
3. Every word lies in one leaf of its length's tree. As a query it goes to the leaves of its own length (from its own leaf
   on, so a pair of leaves meets once) and of the next whose box is within one up and one down (one up for the next): a
   box-prune range search, done level by level for a batch of words at once. A path crosses few planes within that distance, so a word meets a number of leaves that grows
   with the square of the tree's depth at worst and not with the vocabulary.
4. A task gets the words of a leaf and the queries that reached it, searches a small tree over the leaf's words the same
   way, checks vectors and then letter order: one place differs, or the longer word less one letter is the shorter.
   Leaves with many words or queries are dealt out as blocks.
5. Near words leave as pairs; a word has at most some 64 times its length of them, so grouping by word is bounded. A
   word's form is its near word of largest count, if that is ten times its own; roots follow forms by pointer doubling.

Repeated rows count each. A null text has no words; a null id is written as nothing before the colon. Words of one count or shorter
than seven letters are left out. Ties: the smaller word in code-point order. Other columns are ignored; an empty table
has no words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortflow.session import Scope, written, written_with

from .textkit import arrow_batch, ragged

LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY = 7, 2, 10, 31
SAMPLE, LEAF, SMALL = 65_536, 2_000, 8
OWN, ASKED = 8_000, 100_000  # words and queries of a leaf in one block
PAIRS = 1 << 18
LETTERS = 90  # a to z and U+00C0 to U+00FF; upper-case letters of the latter stay what they are
COUNTED, VISITS, NEAR = "word string, n long", "word string, n long, leaf int, own boolean, home boolean", "word string, near string, near_n long"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z lowered. Where ``every`` divides h = crc32 of ``<id>:<run>``, the letter at
    h % length is left out first."""

    def run(batches):
        import re
        import zlib
        from collections import Counter

        runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # other letters have no such bytes in UTF-8
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, at, begun = text.as_buffer().to_pybytes().translate(lower).decode(), 0, zlib.crc32(f"{doc}:".encode())
                while at < len(text):  # a long text in pieces that end after a run
                    end = len(text)
                    if end - at > 1 << 20:
                        gap = re.compile("[^A-Za-zÀ-ÿ]").search(text, at + (1 << 20))
                        end = gap.start() if gap else end
                    for word, n in Counter(runs.findall(text, at, end)).items():
                        h = zlib.crc32(word.encode(), begun)
                        if h % every == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1:]
                        if len(word) >= least_length:
                            counts[word] += n
                    at = end
                if len(counts) > 200_000:
                    yield arrow_batch(COUNTED, [list(counts), list(counts.values())])
                    counts.clear()
        yield arrow_batch(COUNTED, [list(counts), list(counts.values())])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def codes(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, lengths, vectors): letter numbers padded by -1, and letter counts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(cp < 192, cp - 97, cp - 192 + 26).astype(np.int8)
    row = np.repeat(np.arange(len(words)), size)
    out = np.full((len(words), int(size.max(initial=0))), -1, np.int8)
    out[row, np.arange(len(cp)) - np.repeat(np.cumsum(size) - size, size)] = letter
    vectors = np.bincount(row * LETTERS + letter, minlength=len(words) * LETTERS).reshape(len(words), LETTERS)
    return out, size, vectors.astype(np.int16)


class Tree:
    """Splits ``vector[letter] >= at`` over the vectors of one length, as arrays; a leaf has letter -1 and a number.

    ``low`` and ``high`` are the split letter's bounds at a node, from the splits above it.
    """

    def __init__(self, vectors: np.ndarray, most: float, first_leaf: int = 0):
        self.letter, self.at, self.left, self.right, self.low, self.high, self.leaf = [], [], [], [], [], [], []
        self.leaves = first_leaf
        self.rows: list[np.ndarray] = []  # of each leaf
        stack = [(np.arange(len(vectors)), {}, None)]
        while stack:
            rows, box, parent = stack.pop()
            node = len(self.letter)
            if parent is not None:
                (self.left if parent[1] else self.right)[parent[0]] = node
            split = self._split(vectors[rows]) if len(rows) > most else None
            letter, at = split if split else (-1, 0)
            low, high = box.get(letter, (0, 1 << 14))
            for name, value in (("letter", letter), ("at", at), ("left", -1), ("right", -1), ("low", low), ("high", high), ("leaf", -1)):
                getattr(self, name).append(value)
            if not split:
                self.leaf[node] = self.leaves
                self.leaves += 1
                self.rows.append(rows)
                continue
            up = vectors[rows, letter] >= at
            stack.append((rows[up], box | {letter: (at, high)}, (node, False)))
            stack.append((rows[~up], box | {letter: (low, at - 1)}, (node, True)))
        for name in ("letter", "at", "left", "right", "low", "high", "leaf"):
            setattr(self, name, np.array(getattr(self, name), np.int64))

    @staticmethod
    def _split(v: np.ndarray):
        """The letter and count that cut the rows most evenly, or None where all vectors are equal."""
        best = None
        for at in range(1, int(v.max(initial=0)) + 1):
            share = np.count_nonzero(v >= at, axis=0) / len(v)
            gap = np.where((share > 0) & (share < 1), np.abs(share - 0.5), 1.0)
            letter = int(gap.argmin())
            if gap[letter] < 1 and (best is None or gap[letter] < best[0]):
                best = (gap[letter], letter, at)
        return best[1:] if best else None

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.letter[node] >= 0)
            if not len(inner):
                return self.leaf[node]
            n = node[inner]
            node[inner] = np.where(vectors[inner, self.letter[n]] >= self.at[n], self.right[n], self.left[n])

    def within(self, vectors: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is within ``up`` added and ``down`` taken counts of a vector."""
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        more, less = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        rows, leaves = [], []
        while len(row):
            end = self.letter[node] < 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            row, node, more, less = row[~end], node[~end], more[~end], less[~end]
            have = vectors[row, self.letter[node]].astype(np.int64)
            low, high, at = self.low[node], self.high[node], self.at[node]
            r_more = more + np.maximum(at - have, 0) - np.maximum(low - have, 0)
            l_less = less + np.maximum(have - (at - 1), 0) - np.maximum(have - high, 0)
            r, l = r_more <= up, l_less <= down
            row = np.concatenate([row[r], row[l]])
            node, more, less = (np.concatenate([self.right[node[r]], self.left[node[l]]]), np.concatenate([r_more[r], more[l]]),
                                np.concatenate([less[r], l_less[l]]))
        return np.concatenate(rows or [row]), np.concatenate(leaves or [node])


def packed(vectors: np.ndarray) -> np.ndarray:
    """Counts of the letters that differ at all, four bits each (15 stands for all above), 16 letters in a number."""
    v = np.minimum(vectors[:, (vectors != vectors[:1]).any(axis=0)], 15).astype(np.uint64)
    v = np.concatenate([v, np.zeros((len(v), -v.shape[1] % 16), np.uint64)], axis=1)
    return np.bitwise_or.reduce(v.reshape(len(v), -1, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=2)


def letters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters have unlike counts, of rows of :func:`packed`."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.uint8)


def same_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which word pairs of one length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_longer(short: np.ndarray, long: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which longer words less one letter are the shorter; ``size``: lengths of the shorter, both padded to one width."""
    place = np.arange(short.shape[1])
    before = np.logical_and.accumulate((short == long) & (place < size[:, None]), axis=1).sum(axis=1)  # equal letters at the start
    shifted = np.concatenate([long[:, 1:], np.full((len(long), 1), -1, np.int8)], axis=1)
    differ = (short != shifted) & (place < size[:, None])
    last = np.where(differ.any(axis=1), short.shape[1] - differ[:, ::-1].argmax(axis=1), 0)  # past the last place that differs after a shift
    return before >= last


def near_in_leaf(own: list, asked: list):
    """(index of the query, index of the word) of all near pairs of queries and the words of one leaf, which all have one
    length; queries are of that length or one shorter."""
    both, size, v = codes(own + asked)
    v, n = np.ascontiguousarray(v[:, v.any(axis=0)]), len(own)
    tree = Tree(v[:n], SMALL)
    sizes = np.array([len(r) for r in tree.rows])
    flat, starts = np.concatenate(tree.rows), np.cumsum(sizes) - sizes
    bits = packed(v)
    for up, down in ((1, 1), (1, 0)):
        which = n + np.flatnonzero(size[n:] == size[0] - (down == 0))
        for lo in range(0, len(which), 4096):
            ask = which[lo:lo + 4096]
            row, leaf = tree.within(v[ask], up, down)
            ends = np.cumsum(sizes[leaf])
            cuts = [0, *np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) if len(ends) else 0, PAIRS)).tolist(), len(leaf)]
            for a, b in zip(cuts, cuts[1:]):
                q, w = np.repeat(ask[row[a:b]], sizes[leaf[a:b]]), ragged(flat, starts[leaf[a:b]], sizes[leaf[a:b]])
                close = letters_apart(bits[q], bits[w]) <= up + down
                q, w = q[close], w[close]
                close = np.abs(v[q] - v[w]).sum(axis=1) == up + down
                q, w = q[close], w[close]
                right = same_length(both[q], both[w]) if down else one_longer(both[q], both[w], size[q])
                yield q[right] - n, w[right]


def trees(words: DataFrame, total: int, leaf: int = LEAF, sample: int = SAMPLE) -> dict[int, Tree]:
    """A tree for each word length, from at most ``sample`` words, with leaves for about ``leaf`` of all ``total`` words;
    leaf numbers run through all trees."""
    rows = words.select("word").orderBy(F.xxhash64("word")).limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    out, leaves = {}, 0
    for length, some in sorted(by_length.items()):
        out[length] = Tree(codes(some)[2], max(1.0, leaf * len(rows) / max(total, 1)), leaves)
        leaves = out[length].leaves
        out[length].rows = []
    return out


def visits(words: DataFrame, found: dict[int, Tree]) -> DataFrame:
    """(word, n, leaf, own, home): each word in its leaf, and as a query in every leaf within reach; of its own length only
    in its own leaf (``home``) and those of higher number, as the others' words come to its leaf. Lengths that the sample lacks
    have leaf -length for all their words."""

    def run(batches):
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if not words:
                continue
            _, size, v = codes(words)
            lists: list[list] = [[], [], [], []]  # rows of the batch, leaves, own, home
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                place = found[length].place(v[at]) if length in found else np.full(len(at), -length)
                for target, up, down in ((length, 1, 1), (length + 1, 1, 0)):
                    r, l = found[target].within(v[at], up, down) if target in found else (np.arange(len(at)), np.full(len(at), -target))
                    if down:
                        first = l >= place[r]
                        r, l = r[first], l[first]
                    for x, y in zip(lists, (at[r], l, np.zeros(len(r), bool), (l == place[r]) & (target == length))):
                        x.append(y)
                for x, y in zip(lists, (at, place, np.ones(len(at), bool), np.ones(len(at), bool))):
                    x.append(y)
            row, leaves, own, home = (np.concatenate(x) for x in lists)
            for lo in range(0, len(row), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield arrow_batch(VISITS, [[words[i] for i in row[part].tolist()], n[row[part]], leaves[part], own[part], home[part]])

    return words.select("word", "n").mapInArrow(run, VISITS)


def near_pairs(words: DataFrame, total: int, leaf: int = LEAF, sample: int = SAMPLE, own: int = OWN, asked: int = ASKED) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words that differ by one inserted, deleted or replaced letter."""
    met = written(visits(words, trees(words, total, leaf, sample)), "visits")
    sizes = met.groupBy("leaf").agg(F.count_if("own").alias("own_n"), F.count_if(~F.col("own")).alias("asked_n"))
    sizes = sizes.where("own_n > 0 AND asked_n > 0").select(
        "leaf", F.ceil(F.col("own_n") / own).cast("int").alias("own_blocks"), F.ceil(F.col("asked_n") / asked).cast("int").alias("asked_blocks"))
    sizes = written(sizes, "leaves")  # one row a leaf, that is for some 2,000 words
    dealt = met.join(sizes, "leaf").withColumn("h", F.xxhash64("word"))
    all_own, all_asked = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("own_blocks", "asked_blocks"))
    mine, its = F.pmod("h", "own_blocks").cast("int"), F.pmod("h", "asked_blocks").cast("int")
    # A word of the leaf meets every block of queries and a query every block of words: each pair meets once.
    dealt = dealt.withColumn("b", F.explode(F.when(F.col("own"), all_asked).otherwise(all_own)))
    dealt = dealt.select("word", "n", "own", "home", "leaf", F.when(F.col("own"), mine).otherwise(F.col("b")).alias("a"), F.when(F.col("own"), F.col("b")).otherwise(its).alias("b"))

    def search(pdf):
        import pandas as pd

        mine, its = pdf[pdf["own"]], pdf[~pdf["own"]]
        a, b = [], []
        if len(mine) and len(its):
            for q, w in near_in_leaf(mine["word"].tolist(), its["word"].tolist()):
                a.append(q)
                b.append(w)
        q, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        asked, words = its.iloc[q], mine.iloc[w]
        once = ~asked["home"].to_numpy()  # its words do not ask here in turn
        out = [pd.DataFrame({"word": asked["word"].to_numpy(), "near": words["word"].to_numpy(), "near_n": words["n"].to_numpy()}),
               pd.DataFrame({"word": words["word"].to_numpy(), "near": asked["word"].to_numpy(), "near_n": asked["n"].to_numpy()})[once]]
        return pd.concat(out, ignore_index=True)

    return dealt.groupBy("leaf", "a", "b").applyInPandas(search, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: forms followed to the last. Counts grow tenfold with each step, so chains are
    short, and each round doubles the steps taken."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps, seen = written_with(steps.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                                   "roots", n=F.count_if("moved"))
        steps = steps.drop("moved")
        if not seen["n"]:
            return steps


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, factor: int = FACTOR, **trees_of) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word."""
    spark = docs.sparkSession
    with Scope(spark) as scope:
        words, seen = written_with(word_counts(docs, id_col, text_col).where(F.col("n") >= least_count), "words", n=F.count(F.lit(1)))
        # UTF-8 bytes order as code points do, and so do Spark's strings.
        best = F.min_by("near", F.struct(-F.col("near_n"), F.col("near")))
        near = near_pairs(words, seen["n"], **trees_of).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("form"), F.max("near_n").alias("form_n"))
        rows = words.join(near, "word", "left")
        real = F.col("form_n") >= factor * F.col("n")
        rows = written(rows.select("word", F.when(real, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                   F.when(real, F.col("form_n")).alias("form_n")), "forms")
        last = roots(rows.where("form IS NOT NULL"))
        return scope.keep(rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
