"""Language-model scores from a probabilistic suffix tree over words.

Contexts are word sequences of variable length. Every sequence that occurs ``LEAST`` times in the training words is counted,
however large the corpus. A context becomes a node if its next-word distribution differs from that of its
suffix: its count times the divergence must reach ``TAU`` nats; the suffixes of a node are nodes. The distribution of a node
is smoothed by its parent: counted next words share ``count / (node's count + MU)``, the rest goes to the parent's
distribution; the root is add-one-half over all words and one unknown word. All of these sum to one. A text is scored from
the longest suffix of what was read that is a node.

Sequences are 64-bit hashes of their context (all but the last word) and suffix (all but the first). Tasks count them in sorted
blocks, which are dealt by ranges of hashes and summed there; only sequences that occur ``LEAST`` times become rows. Each
length is a written table of (context, suffix, count), and the tree is joins of these tables. A score is the root's plus one gain for each sequence of the tree found in the text (see :func:`gains`), so
texts meet the tree by sequence, and only sums go back to them, both in blocks. Nothing that is collected grows with the corpus: gains of sequences
with a share of ``RARE`` or more go to every task (at most ``1 / RARE`` of a length), the others are joined by shuffle; which
way a sequence takes changes no result. Filters of a fixed size tell tasks what cannot be in a table; what they let through
wrongly is dropped by the join.

A null or empty text is its end alone. A null id is the empty id for the training split. Repeated rows are scored each.
Other columns are ignored. Without training words all counts are zero.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cohortflow.session import drop_table, written, written_with

from .textkit import Hasher, Piece, arrow_batch, mix, pieces

RARE, BITS, LEAST = 2.0**-21, 21, 2
TAU, MU, CONTEXT = 10.0, 16.0, 3
FILTER = 26  # bits of a slot's number in a filter; a key has two slots
WORDS = 8  # bits of the ranges of words
BLOCK = 20  # bits of the tokens that a range of sequences stands for
MOST = 1_000_000  # keys that a group of texts asks for, about; values that are cut into ranges at once
SEARCHED = 1 << 17  # keys that are looked up at once, about
COUNTED, BLOCKS = "context long, suffix long, n long", "part long, rows long, block binary"
END_HASH = np.int64(0x5BF03635D1B54A32)
SENT = "part long, group long, rows long, block binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
VALUES = -1  # the group of blocks with values of keys


class Lookup:
    """Positions of 64-bit keys in a sorted array, by open addressing; -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        self.key, self.at = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            empty = self.at[slot] < 0
            self.at[slot[empty]] = left[empty]  # of several that want a slot the last stays
            won = self.at[slot] == left
            self.key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.int64, copy=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at, hit = self.at[slot], self.key[slot] == keys
        out, open_ = np.where(hit, at, -1).astype(np.int64), np.flatnonzero(~hit & (at >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            at, hit = self.at[slot], self.key[slot] == keys[open_]
            out[open_[hit]] = at[hit]
            more = ~hit & (at >= 0)
            open_, slot = open_[more], slot[more]
        return out


def ordered(keys: np.ndarray) -> np.ndarray:
    """The order that sorts 64-bit keys, equal ones as they came: their upper bits are sorted with positions in the place of the
    lower ones, which numpy does several times faster than its sort of positions; keys that differ in lower bits alone follow."""
    bits = max(1, len(keys) - 1).bit_length()
    both = (keys & np.int64(-1 << bits)) | np.arange(len(keys))
    both.sort()
    order = both & np.int64((1 << bits) - 1)
    k = keys[order]
    wrong = np.flatnonzero(k[1:] < k[:-1])
    if len(wrong):
        upper = k >> np.int64(bits)
        runs = np.unique(upper[wrong])
        lo, hi = np.searchsorted(upper, runs), np.searchsorted(upper, runs, "right")
        at = np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange((hi - lo).sum())
        order[at] = order[at[np.argsort(k[at], kind="stable")]]
    return order


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


class Sums:
    """Counts of 64-bit keys, or of pairs and their keys, in bounded memory: what grows beyond ``most`` is handed out, as one block
    (number, rows, bytes) for each of ``2 ** bits`` ranges of keys."""

    def __init__(self, bits: int, most: int = 1_000_000):
        self.bits, self.most, self.parts, self.size = bits, most, [], 0

    def add(self, keys: np.ndarray, *pair: np.ndarray):
        order = ordered(keys)
        k = keys[order]
        first = starts(k)
        if len(first):
            self.parts.append([k[first], np.diff(np.append(first, len(k))), *(x[order[first]] for x in pair)])
            self.size += len(first)
        if self.size > self.most:
            self.merge()
            if self.size > self.most // 2:
                yield from self.out()

    def merge(self):
        if len(self.parts) > 1:
            k = np.concatenate([x[0] for x in self.parts])
            order = ordered(k)
            k = k[order]
            first = starts(k)
            n = np.add.reduceat(np.concatenate([x[1] for x in self.parts])[order], first)
            pair = [np.concatenate([x[i] for x in self.parts])[order[first]] for i in range(2, len(self.parts[0]))]
            self.parts, self.size = [[k[first], n, *pair]], len(first)

    def out(self):
        self.merge()
        for key, n, *pair in self.parts:
            part = key >> np.int64(64 - self.bits)
            cuts = np.append(starts(part), len(part))
            for a, b in zip(cuts[:-1], cuts[1:]):
                order = a + ordered(pair[0][a:b]) if pair else slice(a, b)
                first, *rest = (x[order] for x in pair or [key])
                yield arrow_batch(BLOCKS, [[int(part[a])], [int(b - a)], [packed(np.diff(first, prepend=np.int64(0)), *rest, n[order])]])
        self.parts, self.size = [], 0


def packed(*columns: np.ndarray) -> bytes:
    """64-bit columns of one length as compressed bytes, all lowest bytes first: what is small or repeated takes little."""
    import pyarrow as pa

    planes = [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T) for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(block: bytes, rows: int, columns: int) -> list[np.ndarray]:
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(block, decompressed_size=8 * rows * columns, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in planes.reshape(columns, 8, rows)]


def by_part(blocks: DataFrame, merge, schema: str, tasks: int | None = None) -> DataFrame:
    """``merge`` of each part's list of blocks (the columns after ``part``), as record batches; all blocks of a part meet in one task."""
    def run(batches):
        at, held = None, []
        for batch in batches:
            for part, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at and held:
                    yield from merge(at, held)
                    held = []
                at = part
                held.append(block)
        if held:
            yield from merge(at, held)

    return blocks.repartition(*[tasks] * (tasks is not None), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def token_hashes(texts: list, hasher: Hasher):
    """(tokens, text numbers) of a piece at a time, with its first text's index: words of each text, then its end."""
    for lo, hi in pieces(texts):
        p = Piece(texts[lo:hi]).lowered()
        a, b, d = p.words()
        h, n = hasher.spans(p.cp, a, b).view(np.int64), hi - lo
        at = np.arange(len(h)) + d  # an end follows each earlier text
        out, doc = np.full(len(h) + n, END_HASH, np.int64), np.empty(len(h) + n, np.int64)
        count = np.bincount(d, minlength=n) + 1
        doc[:] = np.repeat(np.arange(n), count)
        out[at] = h
        yield lo, out, doc


def paired(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of a sequence: Spark's ``xxhash64(context, suffix)``, which tables use."""
    u = np.uint64
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    turned = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    h = np.full(len(context), 42, np.uint64)
    for column in (context, suffix):
        h = (h + p5 + u(8)) ^ (turned(column.view(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        h = h ^ (h >> u(32))
    return h.view(np.int64)


def sequences(tokens: np.ndarray, doc: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the hash of the sequence that ends at each token, and whether the text has it."""
    found = [(tokens, np.ones(len(tokens), bool))]
    for _ in range(1, longest):
        h, ok = found[-1]
        key, has = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        key[1:] = paired(h[:-1], h[1:])
        has[1:] = ok[:-1] & (doc[1:] == doc[:-1])
        found.append((key, has))
    return found


def slots(keys: np.ndarray):
    """The two slots of each key in a filter."""
    return [(keys >> np.int64(shift)) & np.int64((1 << FILTER) - 1) for shift in (0, FILTER)]


def filtered(keys: DataFrame) -> np.ndarray:
    """Filter of the column ``key``: two bits a key, of a fixed size."""
    def bits(batches):
        seen = np.zeros(1 << FILTER, bool)
        for batch in batches:
            for slot in slots(batch.column(0).to_numpy(zero_copy_only=False)):
                seen[slot] = True
        for part, words in enumerate(np.packbits(seen, bitorder="little").view(np.int64).reshape(64, -1)):
            if words.any():
                yield arrow_batch(BLOCKS, [[part], [len(words)], [packed(words)]])

    def merge(part, held):
        words = np.bitwise_or.reduce([unpacked(block, rows, 1)[0] for rows, block in held])
        yield arrow_batch(BLOCKS, [[part], [len(words)], [packed(words)]])

    out = np.zeros((64, 1 << (FILTER - 12)), np.int64)
    for part, rows, block in by_part(keys.select("key").mapInArrow(bits, BLOCKS), merge, BLOCKS).collect():
        out[part] = unpacked(bytes(block), rows, 1)[0]
    return out.ravel().view(np.uint8)


def passes(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    first, second = ((seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 for slot in slots(keys))
    return (first & second) > 0


def counted(rows: DataFrame, length: int, model, bits: int) -> DataFrame:
    """COUNTED of the sequences of this length that the training texts have ``LEAST`` times, of those whose context and suffix
    pass the filter; (key, n) of all words. They are summed in ``2 ** bits`` ranges of their keys."""
    def run(batches):
        hasher, sums = Hasher(), Sums(bits)
        for batch in batches:
            for _, tokens, doc in token_hashes(batch.column(0).to_pylist(), hasher):
                if length == 1:
                    yield from sums.add(tokens)
                    continue
                (shorter, _), (key, has) = sequences(tokens, doc, length)[-2:]
                at = np.flatnonzero(has)
                ok = passes(model.value, shorter)
                at = at[ok[at - 1] & ok[at]]
                yield from sums.add(key[at], shorter[at - 1], shorter[at])
        yield from sums.out()

    def merge(part, held):
        steps, *suffix, n = zip(*(unpacked(block, size, 2 + (length > 1)) for size, block in held))
        cols, n = [np.concatenate([np.cumsum(x) for x in steps]), *map(np.concatenate, suffix)], np.concatenate(n)
        key = paired(*cols) if suffix else cols[0]
        order = ordered(key)
        first = starts(key[order])
        n = np.add.reduceat(n[order], first)
        kept, first = n >= (LEAST if suffix else 1), order[first]
        yield arrow_batch(schema, [*(x[first[kept]] for x in cols), n[kept]])

    schema = COUNTED if length > 1 else "key long, n long"
    return by_part(rows.where("NOT held_out").select("text").mapInArrow(run, BLOCKS), merge, schema, 1 << bits if length > 1 else None)


def grown(found: DataFrame, shorter: DataFrame, tau: float = TAU, mu: float = MU) -> DataFrame:
    """Sequences of one length with ``p``, their last word's probability after their context were it a node, ``gain``, ``rest``
    (log10 of what the context leaves to its parent), ``total`` (the context's count), and ``node``: it diverges enough.
    ``shorter`` has (key, n, p)."""
    with_parent = found.join(shorter.select(F.col("key").alias("suffix"), F.col("p").alias("parent")).hint("shuffle_hash"), "suffix")
    both = with_parent.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("total")).hint("shuffle_hash"), "context")
    each = Window.partitionBy("context")
    share = F.col("n") / F.col("total")
    of = both.withColumns({"seen": F.sum("n").over(each) / F.col("total"), "by_parent": F.least(F.sum("parent").over(each), F.lit(1 - 1e-9)),
                           "apart": F.sum(share * F.log(share / F.col("parent"))).over(each), "left": 1 - F.sum("n").over(each) / (F.col("total") + mu)})
    other = 1 - F.col("seen")
    apart = F.col("apart") + F.when(other > 1e-12, other * F.log(other / (1 - F.col("by_parent")))).otherwise(0.0)
    p = F.col("n") / (F.col("total") + mu) + F.col("left") * F.col("parent")
    return of.select("context", "suffix", "n", "total", p.alias("p"), F.log10(p / (F.col("left") * F.col("parent"))).alias("gain"),
                     F.log10("left").alias("rest"), (F.col("total") * apart >= tau).alias("node"))


def gains(levels: list[DataFrame]) -> DataFrame:
    """(key, n, gain) of the tree's sequences; the levels' tables are dropped.

    After a node an unseen word has the parent's probability times the rest, a counted one its own. So every node adds its
    rest to the score wherever it precedes a word, and every counted word after a node the log of its probability over rest
    times parent's. Suffixes of nodes are nodes and counted words are counted after the suffix, so these add up to the longest
    one's. A sequence may be a context and the end of another: its gains are summed.
    """
    out, longer, done, key = [], None, [], F.xxhash64("context", "suffix").alias("key")
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].where("node").select("context")
        nodes = written((nodes if longer is None else nodes.unionByName(longer)).distinct(), "nodes")
        mine = levels[k].join(nodes.hint("shuffle_hash"), "context", "left_semi")  # each key is there once, so a task's share is small
        heads = mine.groupBy("context").agg(F.first("total").alias("n"), F.first("rest").alias("gain")).withColumnRenamed("context", "key")
        out.append(written(mine.select(key, "n", "gain").unionByName(heads), "level-gains"))
        for table in (levels[k], *done):
            drop_table(table)
        done = [nodes]
        longer = levels[k - 1].withColumn("key", key).join(nodes.withColumnRenamed("context", "key").hint("shuffle_hash"), "key", "left_semi").select(F.col("suffix").alias("context")) if k else None
    found = written(reduce(DataFrame.unionByName, out).groupBy("key").agg(F.max("n").alias("n"), F.sum("gain").alias("gain")), "gains")
    for table in out + done:
        drop_table(table)
    return found


def sent(kind: int, group: int, bits: int, key: np.ndarray, value: np.ndarray):
    """Blocks of SENT of (key, value), one for each range of keys. Parts of words (kind 0) and sequences (1) have their own numbers."""
    order = ordered(key)
    key, value = key[order], value[order]
    part = (kind << bits) + (key >> np.int64(64 - bits)) + (1 << (bits - 1))
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(key) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield arrow_batch(SENT, [[int(part[a])], [group], [int(b - a)], [packed(np.diff(key[a:b], prepend=np.int64(0)), value[a:b])]])


def gathered(table: DataFrame, least: float, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a count of at least ``least`` (a share RARE of all, so 1 / RARE of a length at most), sorted by key."""
    t = table.where(F.col("n") >= F.lit(float(least))).select("key", value).toArrow()
    key, x = t["key"].to_numpy(), t[value].to_numpy()
    order = np.argsort(key)
    return key[order].astype(np.int64), x[order]


def tree(keys: list[np.ndarray], counts: list[np.ndarray], root: np.ndarray, tau: float = TAU, mu: float = MU):
    """The tree of counts in memory (:func:`grown` and :func:`gains` are its form for tables). Per level: log10 probabilities of
    entries given their context, and log10 of what nodes leave to their parents.

    ``keys[k]`` are codes (context's number in level k - 1, word), ``root`` the words' probabilities. A context that is no
    node has NaN as its rest.
    """
    mask = (1 << BITS) - 1
    suffix = [np.full(len(keys[0]), -1, np.int64)]  # of a sequence: without its first word
    lookups = [None]
    for k in range(1, len(keys)):
        context, word = keys[k] >> BITS, keys[k] & mask
        if k == 1:
            suffix.append(word)
        else:
            suffix.append(lookups[k - 1].find((suffix[k - 1][context] << BITS) | word))
        lookups.append(Lookup(keys[k]))
    probs, rests = [root], []
    for k in range(1, len(keys)):
        context, n = keys[k] >> BITS, counts[k].astype(float)
        size = len(keys[k - 1])
        total = counts[k - 1].astype(float)
        parent = probs[k - 1][suffix[k]]  # P(word | context without its first word)
        p = n / total[context]
        seen, by_parent = np.bincount(context, p, size), np.minimum(np.bincount(context, parent, size), 1 - 1e-9)
        other = np.maximum(1 - seen, 0)
        apart = np.bincount(context, p * np.log(p / parent), size)
        apart += np.where(other > 1e-12, other * np.log(np.maximum(other, 1e-12) / (1 - by_parent)), 0)
        node = (total * apart >= tau) & (np.bincount(context, minlength=size) > 0)
        rest = 1 - np.bincount(context, n, size) / (total + mu)
        probs.append(n / (total[context] + mu) + rest[context] * parent)
        rests.append((node, rest))
    for k in range(len(rests) - 1, 0, -1):  # suffixes of nodes are nodes
        rests[k - 1][0][suffix[k][rests[k][0]]] = True
    final = [root]  # now with nodes only: an entry of a context that is no node is read from its suffix
    for k in range(1, len(keys)):
        (node, rest), context, parent = rests[k - 1], keys[k] >> BITS, final[k - 1][suffix[k]]
        own = counts[k] / (counts[k - 1][context] + mu) + rest[context] * parent
        final.append(np.where(node[context], own, parent))
    return [np.log10(x) for x in final[1:]], [np.where(node, np.log10(rest), np.nan) for node, rest in rests]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, context: int = CONTEXT,
           rare: float = RARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; training: other folds."""
    sc = docs.sparkSession.sparkContext
    fold = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"), (fold == held).alias("held_out"), docs[id_col].cast("long").alias("doc_id"))
    vocabulary, size = written_with(counted(rows, 1, None, WORDS), "words", total=F.sum("n"), distinct=F.count("*"))
    total, distinct = size["total"] or 0, size["distinct"] or 0
    least = max(float(LEAST), rare * total)
    below = total + 0.5 * (distinct + 1)
    bits = max(1, int(total).bit_length() - BLOCK)
    shorter = vocabulary.where(F.col("n") >= LEAST).withColumn("p", (F.col("n") + 0.5) / F.lit(float(below)))
    levels: list[DataFrame] = []
    for length in range(2, context + 2):
        found = written(counted(rows, length, sc.broadcast(filtered(shorter)), bits), "counted")
        levels.append(written(grown(found, shorter), "sequences"))
        drop_table(found)
        shorter = levels[-1].select(F.xxhash64("context", "suffix").alias("key"), "n", "p")
    tree_gains = gains(levels)
    word, n = gathered(vocabulary, least, "n")
    key, gain = gathered(tree_gains, least, "gain")
    few = tree_gains.where(F.col("n") < F.lit(least))
    unknown = float(np.log10(0.5 / below)) if below else 0.0
    at = Lookup(key).find(word)  # a word's own gain is found with its number
    own, longer = np.where(at >= 0, np.append(gain, 0.0)[at], 0.0), np.ones(len(key), bool)
    longer[at[at >= 0]] = False
    model = sc.broadcast((Lookup(word), np.log10((n + 0.5) / below), own, Lookup(key[longer]), gain[longer], filtered(few)))
    log = F.log10((F.col("n") + 0.5) / F.lit(float(below)))
    values = [vocabulary.where(F.col("n") < F.lit(least)).select("key", log.alias("value")), few.select("key", F.col("gain").alias("value"))]

    def run(batches):
        from pyspark import TaskContext

        hasher, group = Hasher(), TaskContext.get().partitionId() << 30
        words, base, own, often, gain, seldom = model.value
        for batch in batches:
            texts, heads, asked, first = batch.column(0).to_pylist(), [], ([], []), 0
            for lo, tokens, doc in token_hashes(texts, hasher):
                n = int(doc[-1]) + 1
                at = words.find(tokens)
                known = at >= 0
                base_sum, more = (np.bincount(doc[known], x[at[known]], n) for x in (base, own))
                asked[0].append((tokens[~known], doc[~known] + lo - first))
                may = np.ones(len(tokens), bool)
                for k, (key, has) in enumerate(sequences(tokens, doc, context + 1)):
                    if k:
                        i = np.flatnonzero(has & may if k > 1 else has)  # from three words on, a sequence of the tree has its suffix there
                        j = often.find(key[i])
                        hit = j >= 0
                        more += np.bincount(doc[i[hit]], gain[j[hit]], n)
                        rest = i[~hit]
                    else:
                        i, hit, rest = np.zeros(0, np.int64), np.zeros(0, bool), np.flatnonzero(~known)
                    rest = rest[passes(seldom, key[rest])]
                    asked[1].append((key[rest], doc[rest] + lo - first))
                    may[:] = False
                    may[i[hit]] = may[rest] = True
                heads.append((np.bincount(doc, minlength=n), np.bincount(doc, known, n).astype(np.int64), base_sum.view(np.int64), more.view(np.int64)))
                if sum(len(x) for kind in asked for x, _ in kind) > MOST or lo + n == len(texts):
                    held = batch.column(1).slice(first, lo + n - first).to_numpy(zero_copy_only=False)
                    ids = batch.column(2).slice(first, lo + n - first)
                    cols = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), held, *map(np.concatenate, zip(*heads))]
                    yield arrow_batch(SENT, [[-1 - group], [group], [len(held)], [packed(*cols)]])
                    for kind, found in enumerate(asked):
                        yield from sent(kind, group, bits, *map(np.concatenate, zip(*found)))
                    heads, asked, first, group = [], ([], []), lo + n, group + 1

    def given(kind):
        def blocks(batches):
            held, size = [], 0
            for batch in batches:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
                if size > MOST:
                    yield from values_of(held)
                    held, size = [], 0
            if held:
                yield from values_of(held)

        def values_of(held):
            key, value = map(np.concatenate, zip(*held))
            yield from sent(kind, VALUES, bits, key, value.astype(float).view(np.int64))

        return blocks

    def meet(part, blocks):
        """Sums of each group's texts over the keys of this part: (text, value, known words). What the texts have goes on as it is."""
        if part < 0:
            for group, rows, block in blocks:
                yield arrow_batch(SENT, [[group], [VALUES], [rows], [block]])
            return
        have = [unpacked(block, rows, 2) for group, rows, block in blocks if group == VALUES]
        key, value = (np.concatenate(x) for x in zip([np.zeros(0, np.int64)] * 2, *([np.cumsum(k), v] for k, v in have)))
        find, value = Lookup(key), np.append(value, 0).view(float)
        value[-1] = 0.0 if part >> bits else unknown
        blocks = [x for x in blocks if x[0] != VALUES]
        ends = np.cumsum([rows for _, rows, _ in blocks])
        for few in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(ends // SEARCHED)) + 1):  # small blocks are looked up together
            some = [unpacked(blocks[i][2], blocks[i][1], 2) for i in few]
            found = find.find(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(step) for step, _ in some)]))
            for i, (_, text), at in zip(few, some, np.split(found, np.cumsum([len(step) for step, _ in some])[:-1])):
                sums, known = np.bincount(text, value[at]), np.bincount(text, (at >= 0) & (part >> bits == 0)).astype(np.int64)
                own = np.flatnonzero(sums)
                if len(own):
                    yield arrow_batch(SENT, [[blocks[i][0]], [part >> bits], [len(own)], [packed(own, sums[own].view(np.int64), known[own])]])

    def total_of(_, blocks):
        import pyarrow as pa

        rows, block = next((rows, block) for kind, rows, block in blocks if kind == VALUES)
        ids, null, held, tokens, known, *sums = unpacked(block, rows, 7)
        known, sums = known.copy(), [x.view(float).copy() for x in sums]
        for kind, rows, block in blocks:
            if kind != VALUES:
                text, value, n = unpacked(block, rows, 3)
                sums[kind][text] += value.view(float)
                known[text] += n
        yield arrow_batch(SCORED, [pa.array(ids, mask=null > 0), pa.array(held > 0), tokens, known, sums[0], sums[0] + sums[1]])

    asked = reduce(DataFrame.unionByName, [rows.mapInArrow(run, SENT), *(v.mapInArrow(given(kind), SENT) for kind, v in enumerate(values))])
    scored = by_part(by_part(asked, meet, SENT, 1 << bits), total_of, SCORED, 1 << bits)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
