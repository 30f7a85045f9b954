"""Quality rules by tokeniser fertility, with rejection bands per language or script.

Two public vocabularies read every text: one of pieces with byte fallback, one of byte pairs. Measures of a text: characters
per token for each (over words without digits), the share of byte-fallback tokens, and token entropy (mean over consecutive windows of ``SPAN`` tokens,
each divided by what its size allows, so that it does not drift with length). Bands are Tukey's far fences, three
interquartile ranges beyond the quartiles, over the distinct texts of a language that pass the base rules (copies count
once); a fence is never nearer to its quartile than ``WIDTH``, so texts that hardly differ from the others stay. Short texts, whose measures
scatter, are drawn towards the median (``STEADY``). A text without a language
belongs to the script of most of its letters. A text is rejected if it fails the base rules or leaves a band on the bad side.

A null or empty text has no words and fails the base rules. Repeated rows are judged each. Other columns are kept as they
are by :func:`good`; measures have names of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortflow.session import written

from .textkit import Hasher, Piece, SpanTokens, arrow_batch, byte_bpe, mix, pieces, ragged, sequence_hash

SYMBOLS = "#*$%&|<>"
SPAN = 128
FENCE = 3.0
# Smallest widths of fences: shares of the median (characters per token), absolute values (byte share, entropy).
WIDTH = {"chars_per_piece": 0.05, "chars_per_pair": 0.05, "byte_share": 0.01, "entropy": 0.02}
MOST_BANDS = 10_000
STEADY = 50  # words at which a measure counts for half of its distance from the median
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_piece double, "
            "chars_per_pair double, byte_share double, entropy double")
# First code points of blocks of letters, and their scripts.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x800, "other"),
           (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other")]


def pieces_with_bytes(path: str):
    """Encoder of single words by a piece vocabulary; byte tokens get negative ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    as_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    as_byte = {int(i) for i in np.flatnonzero(as_byte)}
    return lambda words: [[-i if i in as_byte else i for i in x] for x in model.encode(words)]


def per_doc(values, docs, n):
    return np.bincount(docs, weights=values, minlength=n)


def repeated(h: np.ndarray) -> np.ndarray:
    """True where the value is found again elsewhere."""
    order = np.argsort(h, kind="stable")
    x = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = x[1:] == x[:-1]
    out = np.empty(len(h), bool)
    out[order] = same[1:] | same[:-1]
    return out


def earlier(h: np.ndarray) -> np.ndarray:
    """True where the value was found before."""
    out = np.ones(len(h), bool)
    out[np.unique(h, return_index=True)[1]] = False
    return out


def measure(texts: list, hasher: Hasher, piece_tokens: SpanTokens, pair_tokens: SpanTokens) -> list:
    """Columns of MEASURES for the texts, in their order."""
    from types import SimpleNamespace

    found = []
    for lo, hi in pieces(texts):
        part = texts[lo:hi]
        p, n = Piece(part), hi - lo
        a, b, d = p.words()
        o = SimpleNamespace(words=np.bincount(d, minlength=n))
        h = hasher.spans(p.cp, a, b)
        o.chars = per_doc(b - a, d, n)
        o.symbols = per_doc(np.isin(p.cp, [ord(c) for c in SYMBOLS]), p.docs_of(np.arange(len(p.cp))), n) if len(p.cp) else np.zeros(n)
        salt = mix(d.astype(np.uint64) + np.uint64(1))
        # Lines with a word: between line ends and text ends, compared as they stand.
        cut = np.unique(np.concatenate([p.offs, np.flatnonzero(p.cp == 10) + 1]))
        start = cut[:-1] if len(cut) > 1 else cut[:0]
        end = cut[1:].copy() if len(cut) > 1 else cut[:0]
        end -= (p.cp[end - 1] == 10) if len(end) else 0
        has = np.zeros(len(p.cp) + 1, np.int64)
        np.add.at(has, a + 1, 1)
        has = np.cumsum(has)
        ok = has[end] > has[start]
        start, end = start[ok], end[ok]
        ld = p.docs_of(start)
        o.dups = per_doc(earlier(mix(hasher.spans(p.cp, start, end) ^ mix(ld.astype(np.uint64) + np.uint64(1)))), ld, n)
        # Words in windows of three that are found again in the same text.
        at = np.flatnonzero(d[:-2] == d[2:]) if len(d) > 2 else np.zeros(0, np.int64)
        hit = at[repeated(mix(sequence_hash(h, at, 3) ^ salt[at]))] if len(at) else at
        covered = np.zeros(len(d), bool)
        for k in range(3):
            covered[hit + k] = True
        o.repeats = per_doc(covered, d, n)
        # Tokens of words, by either vocabulary.
        number = piece_tokens.table(p, hasher, a, b) if len(a) else a
        sizes = piece_tokens.sizes[number]
        ids, td = ragged(piece_tokens.ids, piece_tokens.starts[number], sizes), np.repeat(d, sizes)
        # Words with a digit (numbers, codes) say nothing about a language: the ratios leave them out.
        digits = np.concatenate([[0], np.cumsum((p.cp >= 48) & (p.cp <= 57))])
        plain = digits[a] == digits[b]
        o.plain_chars, o.plain_tokens = per_doc((b - a) * plain, d, n), per_doc(sizes * plain, d, n)
        o.tokens, o.bytes = np.bincount(td, minlength=n), per_doc(ids < 0, td, n)
        first = np.cumsum(o.tokens) - o.tokens
        window = (np.arange(len(ids)) - first[td]) // SPAN
        windows = (o.tokens + SPAN - 1) // SPAN
        w = (np.cumsum(windows) - windows)[td] + window
        if len(ids):
            key, count = np.unique(w * 131072 + (ids + 65536), return_counts=True)
            kw = key // 131072
            size = np.bincount(w)
            bits = np.bincount(kw, weights=-count * np.log2(count / size[kw]), minlength=len(size))  # entropy times size
            most = np.log2(np.maximum(size, 2)) * size
            wd = np.repeat(np.arange(n), windows)
            o.entropy = per_doc(bits, wd, n) / np.maximum(per_doc(most, wd, n), 1e-9)
        else:
            o.entropy = np.zeros(n)
        number = pair_tokens.table(p, hasher, a, b) if len(a) else a
        o.pairs = per_doc(pair_tokens.sizes[number] * plain, d, n)
        letters = np.searchsorted([x[0] for x in SCRIPTS], p.cp, "right")
        share = np.bincount(p.docs_of(np.arange(len(p.cp))) * 32 + letters, weights=letters > 0, minlength=32 * n).reshape(n, 32) if len(p.cp) else np.zeros((n, 32))
        best = share.argmax(axis=1)
        o.script = [SCRIPTS[i - 1][1] if i else "none" for i in best.tolist()]
        found.append(o)
    if not found:
        return [[]] * 10
    cat = lambda k: np.concatenate([getattr(o, k) for o in found])
    ratio = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y > 0)
    whole = [cat(k).astype(np.int64) for k in ("words", "chars", "symbols", "dups", "repeats")]
    return [*whole, [s for o in found for s in o.script], ratio(cat("plain_chars"), cat("plain_tokens")), ratio(cat("plain_chars"), cat("pairs")),
            ratio(cat("bytes"), cat("tokens").astype(float)), cat("entropy")]


def measured(docs: DataFrame, piece_path: str, pair_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row as one struct ``row``, and its measures."""
    rows = docs.select(F.struct(*[docs[c] for c in (keep or docs.columns)]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                       (docs["lang"] if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa

        hasher = Hasher()
        tokens, pairs = SpanTokens(pieces_with_bytes(piece_path)), SpanTokens(byte_bpe(pair_path))
        for batch in batches:
            found = arrow_batch(MEASURES, measure(batch.column(1).to_pylist(), hasher, tokens, pairs))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *found.columns], ["row", "lang", "text_hash", *found.schema.names])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang string, text_hash long, {MEASURES}")


def judged(found: DataFrame, fence: float = FENCE) -> DataFrame:
    """``found`` with ``base_failed`` and ``kept``; ``found`` is read twice, so it should be a written table."""
    found = found.withColumn("band", F.coalesce("lang", "script")).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    quart = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"q_{c}")
    texts = found.where("NOT base_failed").groupBy("band", "text_hash").agg(*[F.first(c).alias(c) for c in WIDTH])
    bands = written(texts.groupBy("band").agg(*[quart(c) for c in WIDTH]), "bands")
    if bands.count() <= MOST_BANDS:  # twelve numbers a language; more than that are joined by shuffle
        bands = F.broadcast(bands)

    def off(c):  # distance from the median, less for short texts, in interquartile ranges beyond the quartile on that side
        q = F.col(f"q_{c}")
        away = (F.col(c) - q[1]) * F.col("n_words") / (F.col("n_words") + STEADY)
        width = F.greatest(fence * (q[2] - q[0]), WIDTH[c] * (q[1] if c.startswith("chars") else F.lit(1.0)))
        return away, q[0] - q[1] - width, q[2] - q[1] + width

    low = lambda c: off(c)[0] < off(c)[1]
    high = lambda c: off(c)[0] > off(c)[2]
    out = low("chars_per_piece") | low("chars_per_pair") | high("byte_share") | low("entropy")
    return found.join(bands, "band", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(out, F.lit(False)))


def good(docs: DataFrame, piece_path: str, pair_path: str, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that the rules keep."""
    found = written(measured(docs, piece_path, pair_path, text_col), "measured")
    return judged(found).where("kept").select("row.*")
