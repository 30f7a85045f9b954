"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's features are shapes of its characters and words and those of the
line before and after. The field is trained on a bounded sample of labelled documents (``SAMPLE`` rows, those of smallest
hash), whose lines take their document's label; its gradient comes from forward-backward over all sample lines. A document's
quality is the length-weighted mean of its lines' marginals, and a logistic curve fitted on the sample turns it into a score.

Labels of held-out rows (and language, source and id of any row) never reach the field. Null and empty texts, and texts
without words, are one empty line. Repeated rows are scored each; labels of ids that occur twice count twice. Without
labels of both kinds every score is the share of good ones (1/2 without any). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .fertility import earlier, repeated
from .textkit import Hasher, Piece, arrow_batch, mix, pieces, sequence_hash

SAMPLE, STEPS, RIDGE = 4000, 120, 1e-3
NAMES = ("chars", "words", "word length", "upper", "digits", "stops", "marks", "symbols", "bars", "shouts", "new words", "said before", "line before", "closed", "many chars a word")


def line_features(texts: list, hasher: Hasher):
    """Per piece: (features of lines, lengths of lines, document number of each line), documents in order."""
    for lo, hi in pieces(texts):
        p, n = Piece(texts[lo:hi]), hi - lo
        cp = p.cp
        a, b, d = p.words()
        cut = np.unique(np.concatenate([p.offs, np.flatnonzero(cp == 10) + 1]))
        start, end = cut[:-1], cut[1:]
        line = np.searchsorted(start, a, "right") - 1
        count = np.bincount(line, minlength=len(start))
        real = np.flatnonzero(count)
        number = np.full(len(start), -1)
        number[real] = np.arange(len(real))
        start, end, line, count, m = start[real], end[real], number[line], count[real].astype(float), len(real)
        doc = p.docs_of(start)
        size = (end - start).astype(float)

        def share(mask):
            run = np.concatenate([[0], np.cumsum(mask)])
            return (run[end] - run[start]) / size  # noqa: B023

        h = hasher.spans(cp, a, b)
        is_new = ~earlier(mix(h ^ mix(line.astype(np.uint64) + np.uint64(1))))
        at = np.flatnonzero(d[:-2] == d[2:]) if len(d) > 2 else np.zeros(0, np.int64)
        hit = at[repeated(mix(sequence_hash(h, at, 3) ^ mix(d[at].astype(np.uint64) + np.uint64(1))))] if len(at) else at
        said = np.zeros(len(a), bool)
        for k in range(3):
            said[hit + k] = True
        chars = np.bincount(line, b - a, m)
        ends = cp[b[np.searchsorted(line, np.arange(m), "right") - 1] - 1] if m else np.zeros(0)
        whole = hasher.spans(cp, start, end - (cp[end - 1] == 10)) if m else np.zeros(0, np.uint64)
        x = np.stack([
            np.log1p(size), np.log1p(count), chars / np.maximum(count, 1), share((cp >= 65) & (cp <= 90) | (cp >= 0xC0) & (cp <= 0xDE)),
            share((cp >= 48) & (cp <= 57)), share(np.isin(cp, [44, 46, 58, 59])), share((cp > 32) & (cp < 48) | (cp > 57) & (cp < 65) | (cp > 90) & (cp < 97) | (cp > 122) & (cp < 127)),
            share(np.isin(cp, [ord(c) for c in "#*$%&<>"])), share(cp == 124), share(cp == 33), np.bincount(line, is_new, m) / np.maximum(count, 1),
            np.bincount(line, said, m) / np.maximum(count, 1), earlier(mix(whole ^ mix(doc.astype(np.uint64) + np.uint64(1)))).astype(float) if m else np.zeros(0),
            np.isin(ends, [33, 46, 63]).astype(float), (chars / np.maximum(count, 1) > 14).astype(float)], axis=1)
        x[:, 3:10] = np.sqrt(x[:, 3:10])
        none = np.setdiff1d(np.arange(n), doc)
        if len(none):
            x, size, doc = np.concatenate([x, np.zeros((len(none), x.shape[1]))]), np.concatenate([size, np.zeros(len(none))]), np.concatenate([doc, none])
            order = np.argsort(doc, kind="stable")
            x, size, doc = x[order], size[order], doc[order]
        yield x, size + 1, doc


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines around it in its document (zeros at the ends) and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = doc[1:] == doc[:-1]
    before[1:][same], after[:-1][same] = x[:-1][same], x[1:][same]
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


class Chains:
    """Forward-backward over many chains at once; a step goes over the t-th lines of all chains that have one."""

    def __init__(self, doc: np.ndarray):
        sizes = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        counts = -np.sort(-sizes)
        self.steps = [first[order[:k]] + t for t, k in enumerate(np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), "right"))]

    def marginals(self, scores: np.ndarray, moves: np.ndarray):
        """(marginals of lines, expected moves, log of the sum over all labellings); scores (lines, 2), moves (2, 2)."""
        from_left, from_right = np.zeros_like(scores), np.zeros_like(scores)
        for t, at in enumerate(self.steps):
            if t == 0:
                from_left[at] = scores[at]
            else:
                old = from_left[self.steps[t - 1][:len(at)]]
                from_left[at] = scores[at] + np.logaddexp(old[:, :1] + moves[0], old[:, 1:] + moves[1])
        for t in range(len(self.steps) - 2, -1, -1):
            k = len(self.steps[t + 1])
            right = scores[self.steps[t + 1]] + from_right[self.steps[t + 1]]
            from_right[self.steps[t][:k]] = np.logaddexp(right[:, :1] + moves[:, 0], right[:, 1:] + moves[:, 1])
        both = from_left + from_right
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        expected = np.zeros((2, 2))
        for t in range(1, len(self.steps)):
            at = self.steps[t]
            old = self.steps[t - 1][:len(at)]
            pair = from_left[old][:, :, None] + moves + (scores[at] + from_right[at])[:, None, :] - log_z[at][:, None, None]
            expected += np.exp(pair).sum(axis=0)
        return np.exp(both - log_z[:, None]), expected, log_z[self.steps[0]].sum() if self.steps else 0.0


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = RIDGE):
    """(mean, scale, weights, moves) of the field; y: label of each line. Adam on the mean log likelihood of lines."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    f = with_neighbours((x - mean) / scale, doc)
    chains, n = Chains(doc), len(y)
    w, moves = np.zeros(f.shape[1]), np.zeros((2, 2))
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    m1 = m2 = np.zeros(len(w) + 4)
    for i in range(1, steps + 1):
        s = np.zeros((n, 2))
        s[:, 1] = f @ w
        p, expected, _ = chains.marginals(s, moves)
        g = np.concatenate([f.T @ (y - p[:, 1]) / n - ridge * w, ((seen - expected) / n - ridge * moves).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        w, moves = w + step[:-4], moves + step[-4:].reshape(2, 2)
    return mean, scale, w, moves


def qualities(x, size, doc, field) -> np.ndarray:
    """Length-weighted mean of the lines' probability of being good, for each document."""
    mean, scale, w, moves = field
    s = np.zeros((len(x), 2))
    s[:, 1] = with_neighbours((x - mean) / scale, doc) @ w
    p = Chains(doc).marginals(s, moves)[0][:, 1]
    return np.bincount(doc, p * size) / np.bincount(doc, size)


def curve(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from quality to label; Newton steps on the penalised likelihood."""
    f, b = np.stack([q - 0.5, np.ones(len(q))], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-f @ b))
        b = b + np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-2, 1e-6]) * 1.0, f.T @ (y - p) - np.array([1e-2, 1e-6]) * b)
    return float(b[0]), float(b[1])


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0,
           sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    fold = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != held))
    some = known.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(docs[text_col], F.lit("")).alias("text")
    train = docs.select(docs[id_col].cast("long").alias("doc_id"), text).join(F.broadcast(some), "doc_id").select("label", "text")  # ``sample`` rows at most

    def features(batches):
        hasher = Hasher()
        for batch in batches:
            out, of, at = [], batch.column(0).to_pylist(), 0
            for x, size, doc in line_features(batch.column(1).to_pylist(), hasher):
                cuts = np.searchsorted(doc, np.arange(doc[-1] + 2))
                for i in range(doc[-1] + 1):
                    out.append((of[at + i], x[cuts[i]:cuts[i + 1]].astype("<f8").tobytes(), size[cuts[i]:cuts[i + 1]].astype("<f8").tobytes()))
                at += int(doc[-1]) + 1
            yield arrow_batch("label int, x binary, size binary", list(zip(*out)) if out else [[]] * 3)

    rows = train.mapInArrow(features, "label int, x binary, size binary").toArrow().to_pylist()
    y = np.array([r["label"] for r in rows], np.int64)
    field, slope, offset = None, 0.0, 0.0
    if len(rows) and 0 < y.mean() < 1:
        size = np.concatenate([np.frombuffer(r["size"]) for r in rows])
        x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, len(NAMES)) for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r["size"]) // 8 for r in rows])
        field = fit(x, doc, y[doc])
        slope, offset = curve(qualities(x, size, doc, field), y)
    elif len(rows):
        offset = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            q = [qualities(*part, field) if field else np.zeros(part[2][-1] + 1) for part in line_features(batch.column(2).to_pylist(), hasher)]
            q = np.concatenate(q) if q else np.zeros(0)
            s = 1 / (1 + np.exp(-(slope * (q - 0.5) + offset)))
            yield arrow_batch("doc_id long, held_out boolean, score double, predicted int", [batch.column(0), batch.column(1), s, (s >= cut).astype(np.int32)])

    whole = docs.select(docs[id_col].cast("long").alias("doc_id"), (fold(docs[id_col]) == held).alias("held_out"), text)
    return whole.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
