"""Packing by non-negative least squares over length combinations that fill a window.

1. Tokenise (added tokens in a text have their own ids): a document of n ids is cut into whole windows and a rest; whole
   windows are sequences of their own. The rest's ids are kept (two bytes each), with the row's place among rests of its
   length in its partition.
2. The histogram of rest lengths (at most ``window`` numbers) goes to the driver. Combinations of up to four lengths that
   sum to the window are enumerated, and repeat counts that best explain the histogram are solved by non-negative least
   squares (coordinate descent), rounded down and held to what is there.
3. Rests left over are taken longest first and laid end to end; where one crosses a window's end it is cut.

A rest's sequence follows from its length and its place among all rests of that length, by arithmetic: places are counts
per (length, partition) and running sums over partitions, so a crowded length is no single task's work, and no pass
gathers rests. Only the last sequence has padding.

A null or empty text is its end id alone. Repeated rows are packed each. Other columns are ignored; an empty table gives
no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cohortflow.session import written

from .textkit import Hasher, SpanTokens, added_tokens, arrow_batch, byte_bpe, ids_with_added, source_array

WINDOW, END = 1024, 0
TOKENISED = "doc_id long, n long, crcs array<long>, rest binary, at long, full_at long, part int, len int"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(present: np.ndarray, window: int = WINDOW, spread: int = 24) -> list[tuple[int, ...]]:
    """Sorted length tuples that sum to ``window``, lengths taken from ``present``: all pairs, and for each shortest part
    ``spread`` evenly spaced ways to fill the remainder with two or three more parts."""
    there = set(present.tolist())
    found = {(a, window - a) for a in there if window - a in there and a <= window - a}
    for a in sorted(there):
        for b in np.unique(np.linspace(a, (window - a) // 2, spread).astype(int)).tolist() if 3 * a <= window else ():
            c = window - a - b
            if b in there and c in there and a <= b <= c:
                found.add((a, b, c))
            half = (window - a - b) // 2
            if 4 * a <= window and b in there and half >= b and half in there and window - a - b - half in there:
                found.add(tuple(sorted((a, b, half, window - a - b - half))))
    return sorted(found)


def repeats(hist: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 60) -> np.ndarray:
    """x >= 0 that minimises the squared difference of the lengths used and ``hist``; coordinate descent, one pass after
    another until nothing moves by a repeat."""
    uses = [np.unique(c, return_counts=True) for c in combos]
    x, rest = np.zeros(len(combos)), hist.astype(float).copy()
    for _ in range(rounds):
        moved = 0.0
        for j, (at, n) in enumerate(uses):
            step = max(-x[j], float(rest[at] @ n) / float(n @ n))
            if step:
                x[j] += step
                rest[at] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW):
    """(whole, table, used, sequences): for each length the ranges of places that combinations take.

    ``table[l]`` lists (first place, last place excluded, repeats' first sequence, parts of this length in one, offset of
    the first); ``used[l]`` places are taken, ``sequences`` sequences are full.
    """
    combos = combinations(np.flatnonzero(hist), window)
    x = np.floor(repeats(hist, combos)).astype(np.int64)
    left, counts = hist.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for wish in (x, np.full(len(combos), np.iinfo(np.int64).max)):  # the solution, then what else fits
        for j in np.argsort(-wish, kind="stable"):
            at, n = np.unique(combos[j], return_counts=True)
            take = int(min(wish[j] - counts[j], (left[at] // n).min()))
            if take > 0:
                counts[j] += take
                left[at] -= take * n
    table: dict[int, list] = {}
    used, sequences = np.zeros(len(hist), np.int64), 0
    for j in np.flatnonzero(counts):
        offset = 0
        for length in sorted(set(combos[j])):
            n = combos[j].count(length)
            table.setdefault(length, []).append((int(used[length]), int(used[length] + n * counts[j]), sequences, n, offset))
            used[length] += n * counts[j]
            offset += n * length
        sequences += int(counts[j])
    return table, used, sequences


def tokenised(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc_id, n, crcs, rest, at, full_at, part): checksums of whole windows, the rest's ids, places in the partition."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, places, full = TaskContext.get().partitionId(), {}, 0
        hasher, spans, added = Hasher(), SpanTokens(byte_bpe(vocabulary)), added_tokens(vocabulary)
        for batch in batches:
            rows = []
            for ids in ids_with_added(batch.column(1).to_pylist(), spans, hasher, added):
                n = len(ids) + 1
                ids = np.append(ids, END).astype("<u4")
                whole, rest = divmod(n, window)
                crcs = [zlib.crc32(ids[i * window:(i + 1) * window].tobytes()) for i in range(whole)]
                at = places.get(rest, 0)
                rows.append((n, crcs, ids[whole * window:].astype("<u2").tobytes(), at, full, part, rest))
                places[rest] = at + 1
                full += whole
            yield arrow_batch(TOKENISED, [batch.column(0), *(zip(*rows) if rows else [[]] * 7)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, TOKENISED)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece."""
    rows = written(tokenised(docs, vocabulary, id_col, text_col, window), "tokens")
    counts = rows.groupBy("part", "len").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("full"))
    counts = written(counts, "lengths")  # window rows at most for each partition
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect():  # window rows at most
        hist[r["len"]] = r["n"]
    hist[0] = 0
    table, used, sequences = plan(hist, window)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before.partitionBy("len")), F.lit(0)))
    # Whole windows come after all sequences made of rests.
    tail = np.concatenate([[0], np.cumsum(((hist - used) * np.arange(window))[::-1])])[::-1]  # ids of longer rests left over
    loose = int(-(-tail[0] // window))
    full = counts.groupBy("part").agg(F.sum("full").alias("full"))
    full = full.select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_before"))  # one row a partition
    starts = starts.select("part", "len", "before").join(full, "part")
    placed = rows.join(starts, ["part", "len"]).select("doc_id", "n", "crcs", "rest", "at", "full_at", "len", "before", "full_before")

    def run(batches):
        for batch in batches:
            out, source = [], []
            for row, (n, crcs, rest, at, full_at, length, b, fb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 9)))):
                first = len(out)
                for i, crc in enumerate(crcs):
                    out.append((i * window, window, crc, n, sequences + loose + fb + full_at + i, 0))
                ids, start, place = np.frombuffer(rest, "<u2").astype("<u4"), n - length, b + at
                if length and place < used[length]:
                    lo, _, seq, many, offset = next(x for x in table[length] if x[0] <= place < x[1])
                    out.append((start, length, zlib.crc32(ids.tobytes()), n, seq + (place - lo) // many, offset + (place - lo) % many * length))
                elif length:
                    begin, done = int(tail[length + 1] + (place - used[length]) * length), 0
                    while done < length:
                        seq, offset = divmod(begin + done, window)
                        m = min(length - done, window - offset)
                        out.append((start + done, m, zlib.crc32(ids[done:done + m].tobytes()), n, sequences + seq, offset))
                        done += m
                source += [row] * (len(out) - first)
            yield arrow_batch(PIECES, [batch.column(0).take(source_array(source)), *(zip(*out) if out else [[]] * 6)])

    return placed.mapInArrow(run, PIECES)
