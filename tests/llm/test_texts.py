"""Kernels, scores, rules, labels and spans against plain Python."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given as drawn, settings, strategies as st

from cohortflow.llm import deobfuscation, fertility, line_crf, suffix_tree, textkit
from cohortflow.llm.queries import QUERIES, vocabulary
from cohortflow.session import Scope, work_folder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@drawn(st.lists(st.text(alphabet="ab'sC \t\n  é１9.#中", max_size=40), min_size=1, max_size=6))
def test_kernels_equal_plain_code(texts):
    p = textkit.Piece(texts)
    a, b, d = p.words()
    assert [(int(i), texts[i][x - p.offs[i]:y - p.offs[i]]) for x, y, i in zip(a, b, d)] == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = textkit.token_ids(texts, textkit.SpanTokens(textkit.byte_bpe(vocabulary("byte_bpe_50k.json"))), textkit.Hasher())
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_tokens_of_given_texts(given):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [x for _, x in given] + ["<|endoftext|> it's 'tis", "x" * 5000]
    spans = textkit.SpanTokens(textkit.byte_bpe(vocabulary("byte_bpe_50k.json")), most=500)  # forgets many times
    assert [x.tolist() for x in textkit.token_ids(texts, spans, textkit.Hasher())] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_shingles(given):
    texts = [t for _, t in given[:60]] + ["", "a", "a b c d", "a b c d e", "A B C D E"]
    for t, x in zip(texts, textkit.distinct_shingles(texts, textkit.Hasher())):
        w = WORD.findall(t.translate(LOW))
        assert len(x) == len({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else ())
    *_, a, b = textkit.distinct_shingles(texts, textkit.Hasher())
    assert a.tolist() == b.tolist()


def scored(rows):
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in rows]  # None: the end
    held = [zlib.crc32((str(d) if d is not None else "").encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for (d, _), t, h in zip(rows, tokens, held)]


def same_scores(found, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    for x, y in zip(got, sorted(scored(rows), key=key), strict=True):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-6 * max(1, abs(y[5]))


def test_suffix_tree_base_and_gain(spark, given):
    found = QUERIES["op1_suffix_tree"](spark, SF).collect()
    same_scores(found, given)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)


def test_suffix_tree_odd_rows(odd, nothing):
    same_scores(suffix_tree.scores(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert suffix_tree.scores(nothing).count() == 0


def test_suffix_tree_probabilities_sum_to_one():
    """Every node's distribution over all words and one unknown word, as scoring computes it."""
    rng = np.random.default_rng(1)
    seq = [0, 1, 2] * 40 + rng.integers(0, 6, 300).tolist()
    keys, counts = [np.arange(6)], [np.bincount(seq, minlength=6)]
    ends = [np.array(seq)]
    for _ in range(2):
        code = np.append(-1, (ends[-1][:-1] << suffix_tree.BITS) | ends[0][1:])
        code[1:][ends[-1][:-1] < 0] = -1
        k, n = np.unique(code[code >= 0], return_counts=True)
        k, n = k[n >= 3], n[n >= 3]
        keys.append(k)
        counts.append(n)
        ends.append(suffix_tree.Lookup(k).find(code))
    total, v = sum(counts[0]), 6
    root = (counts[0] + 0.5) / (total + 0.5 * (v + 1))
    entries, rests = suffix_tree.tree(keys, counts, root, tau=2.0)
    finds = [None, *[suffix_tree.Lookup(k) for k in keys[1:]]]
    nodes = 0
    for a in range(6):
        for b in range(6):
            sums, unknown = 0.0, 0.5 / (total + 0.5 * (v + 1))
            two = int(finds[1].find(np.array([(a << suffix_tree.BITS) | b]))[0])
            for w in [*range(6), None]:
                p = math.log10(root[w] if w is not None else unknown)
                for k, context in ((1, b), (2, two)):
                    if context < 0 or math.isnan(rests[k - 1][context]):
                        continue
                    nodes += 1
                    e = int(finds[k].find(np.array([(context << suffix_tree.BITS) | w]))[0]) if w is not None else -1
                    p = entries[k - 1][e] if e >= 0 else rests[k - 1][context] + p
                sums += 10**p
            assert abs(sums - 1) < 1e-9
    assert nodes


def tree_scores(rows, tau=suffix_tree.TAU, mu=suffix_tree.MU, context=suffix_tree.CONTEXT):
    """Scores by a tree of dictionaries over every sequence that occurs twice."""
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in rows]
    train = [t for (d, _), t in zip(rows, tokens) if zlib.crc32((str(d) if d is not None else "").encode()) % 5 != 1]
    c = [Counter(tuple(t[i:i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, context + 2)]
    below = sum(c[0].values()) + 0.5 * (len(c[0]) + 1)
    p, rest, nodes = {g: (n + 0.5) / below for g, n in c[0].items()}, {}, set()
    for k in range(1, context + 1):
        after = {}
        for g, n in c[k].items():
            if n >= 2:
                after.setdefault(g[:-1], []).append((g, n))
        for ctx, found in after.items():
            total = c[k - 1][ctx]
            rest[ctx] = 1 - sum(n for _, n in found) / (total + mu)
            other = 1 - sum(n for _, n in found) / total
            apart = sum(n / total * math.log(n / total / p[g[1:]]) for g, n in found)
            apart += other * math.log(other / (1 - min(sum(p[g[1:]] for g, _ in found), 1 - 1e-9))) if other > 1e-12 else 0
            if total * apart >= tau:
                nodes |= {ctx[i:] for i in range(k)}
            p.update({g: n / (total + mu) + rest[ctx] * p[g[1:]] for g, n in found})

    def one(t, i):
        v = math.log10(p.get((t[i],), 0.5 / below))
        for k in range(1, min(context, i) + 1):
            ctx = tuple(t[i - k:i])
            if ctx in nodes:
                g = (*ctx, t[i])
                v = math.log10(p[g]) if c[k][g] >= 2 else v + math.log10(rest[ctx])
        return v

    return sorted(((d, len(t), sum(one(t, i) for i in range(len(t)))) for (d, _), t in zip(rows, tokens)))


@pytest.mark.parametrize("rare", [suffix_tree.RARE, 2.0**-9, 1.0])
def test_suffix_tree_learns_by_count_at_every_size(spark, given, rare):
    """A table whose rare share is far above two occurrences, as on a large corpus, has the same tree."""
    rows = given + [(10**6 + i, f"x{i} one rare phrase of ten y{i}") for i in range(14)]
    found = suffix_tree.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rare=rare).collect()
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in found)
    for x, y in zip(got, tree_scores(rows), strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 * max(1, abs(y[2]))


def test_suffix_tree_counts_in_blocks(spark):
    """Sequences come from blocks of key ranges as brute force counts them, and no row is made for one that occurs once."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, 30)) for _ in range(40)]
    rows = spark.createDataFrame([(t, False) for t in texts] + [("w1 w1 held out", True)], "text string, held_out boolean").repartition(3)
    everything = np.full(1 << (suffix_tree.FILTER - 3), 255, np.uint8)
    found = suffix_tree.counted(rows, 3, spark.sparkContext.broadcast(everything), 4).withColumn("key", suffix_tree.F.xxhash64("context", "suffix")).collect()
    tokens = [t.split() + [None] for t in texts]
    c = Counter(tuple(t[i:i + 3]) for t in tokens for i in range(len(t) - 2))
    assert sorted(r.n for r in found) == sorted(n for n in c.values() if n >= 2)
    keys, context, suffix = (np.array([r[x] for r in found]) for x in ("key", "context", "suffix"))
    assert len(set(keys)) == len(keys) and (suffix_tree.paired(context, suffix) == keys).all()


def test_suffix_tree_blocks_and_filters():
    """What is packed comes back, blocks hold their ranges alone and take half of what their columns take."""
    rng = np.random.default_rng(4)
    words = rng.integers(-2**63, 2**63 - 1, 3000)
    context, suffix = words[rng.integers(0, 3000, 50_000)], words[rng.integers(0, 3000, 50_000)]
    sums = suffix_tree.Sums(3)
    assert not list(sums.add(suffix_tree.paired(context, suffix), context, suffix))
    blocks, got = [next(zip(*b.to_pydict().values())) for b in sums.out()], Counter()
    for part, rows, block in blocks:
        steps, s, n = suffix_tree.unpacked(block, rows, 3)
        c = np.cumsum(steps)
        assert set(suffix_tree.paired(c, s) >> 61) == {part}
        got.update(dict(zip(zip(c.tolist(), s.tolist()), n.tolist())))
    assert got == Counter(zip(context.tolist(), suffix.tolist())) and len(blocks) == 8
    assert 2 * sum(len(b) for *_, b in blocks) < 32 * sum(rows for _, rows, _ in blocks)


def test_suffix_tree_orders_and_finds_keys():
    """Keys are ordered as a stable sort orders them, also where they differ in lower bits alone, and each is found."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5000):
        for keys in (rng.integers(-2**63, 2**63 - 1, n), rng.integers(-5, 5, n), (rng.integers(-4, 4, n) << 20) + rng.integers(0, 3000, n)):
            assert (suffix_tree.ordered(keys) == np.argsort(keys, kind="stable")).all()
            distinct = np.unique(keys)
            assert (distinct[suffix_tree.Lookup(distinct).find(keys)] == keys).all()
            assert (suffix_tree.Lookup(distinct).find(np.array([2**40, 2**41 + 1])) == -1).all()


def test_suffix_tree_values_are_sent_in_large_blocks(spark, given, monkeypatch):
    """Values of the tree go out in a block for each task and range of keys, not in one for each batch of rows."""
    seen, by_part = [], suffix_tree.by_part
    monkeypatch.setattr(suffix_tree, "by_part", lambda blocks, *a: by_part((seen.append(blocks), blocks)[1], *a))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        suffix_tree.scores(spark.createDataFrame(given[:200], "doc_id long, text string"))
        asked = seen[-2].where(f"`group` = {suffix_tree.VALUES} AND part >= 0").select("part", "rows", suffix_tree.F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(r.rows for r in asked) > 1000 and len(asked) == len({(r.part, r.task) for r in asked})


def test_suffix_tree_keeps_two_tables(spark, given):
    """What only builds the tree is gone before texts are scored."""
    with Scope(spark) as scope:
        found = suffix_tree.scores(spark.createDataFrame(given[:200], "doc_id long, text string"))
        folder = f"{work_folder(spark)}/cohortflow/{spark.sparkContext.applicationId}/{scope.name}".removeprefix("file://")
        assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(folder)) == ["gains", "words"]
        assert found.count() == 200


def test_word_hashes_are_the_same_beside_rare_code_points():
    texts = ["a word é 中文", "a word é 中文 \U0001F600"]
    first, second = ([h for _, tokens, _ in suffix_tree.token_hashes([t], textkit.Hasher()) for h in tokens.tolist()] for t in texts)
    assert first[:-1] == second[:4]


def test_suffix_tree_filter_lets_all_its_keys_through(spark):
    keys = np.random.default_rng(5).integers(-2**63, 2**63 - 1, 4000)
    seen = suffix_tree.filtered(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3))
    other = np.random.default_rng(6).integers(-2**63, 2**63 - 1, 200_000)
    assert suffix_tree.passes(seen, keys).all() and suffix_tree.passes(seen, other).sum() <= 2


def counted(t):
    w = WORD.findall(t or "")
    tri, covered, seen, dups = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if tri[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dups += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dups, len(covered)


def test_fertility_counts(spark, given, odd, nothing):
    found = {r.doc_id: r for r in QUERIES["op2_fertility"](spark, SF).collect()}
    for d, t in given:
        r, e = found[d], counted(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and not (r.base_failed and r.kept)
    paths = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
    kept = fertility.good(odd, *paths)
    assert kept.columns == odd.columns
    assert {(r.doc_id, r.row) for r in kept.collect()} <= {(8, "x"), (9, "x")}
    assert fertility.good(nothing, *paths).count() == 0
    assert sorted(counted(r.text) for r in odd.collect()) == sorted(
        (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in fertility.measured(odd, *paths).collect())


def test_fertility_keeps_good_and_rejects_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = [r for r in QUERIES["op2_fertility"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in found if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_fertility_bands_have_width(spark):
    """Copies count once, and a text that hardly leaves a narrow band stays; one that leaves it far goes."""
    row = lambda i, h, piece=4.0, share=0.0, entropy=0.9: (i, "en", h, 400, 0, "latin", piece, 4.0, share, entropy)
    rows = [row(i, 0, 4.5, 0.0, 0.95) for i in range(60)] + [row(100 + i, 1 + i, 3.6 + 0.02 * i, 0.0, 0.86 + 0.002 * i) for i in range(30)]
    rows += [row(200, 201, 4.0, 0.002), row(201, 202, 4.0, 0.4), row(202, 203, 1.0)]
    cols = "id long, lang string, text_hash long, n_words long, n_repeat_words long, script string, chars_per_piece double, chars_per_pair double, byte_share double, entropy double"
    kept = {r.id: r.kept for r in fertility.judged(spark.createDataFrame(rows, cols)).collect()}
    assert all(kept[r[0]] for r in rows[:-2]) and not kept[201] and not kept[202]


def test_fertility_script_groups():
    h = textkit.Hasher()
    tokens = textkit.SpanTokens(fertility.pieces_with_bytes(vocabulary("piece_bpe_32k.model"))), textkit.SpanTokens(textkit.byte_bpe(vocabulary("byte_bpe_50k.json")))
    found = fertility.measure(["plain words", "Привет мир", "中文 字", "123", "", "ꙮ ꙮ"], h, *tokens)
    assert found[5] == ["latin", "cyrillic", "han", "none", "none", "other"]
    assert found[8][0] == 0 and found[8][5] > 0.5  # byte fallback


def test_line_field_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in QUERIES["op3_line_crf"](spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_line_field_odd_rows(spark, odd, nothing):
    some = spark.createDataFrame([(5, 1), (8, 0), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    found = line_crf.scores(odd, some).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert {round(r.score, 6) for r in line_crf.scores(odd, some.limit(0)).collect()} == {0.5}
    assert line_crf.scores(nothing, some).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    doc, s, moves = np.array([0, 1, 1, 1, 2, 2]), rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    p, expected, log_z = line_crf.Chains(doc).marginals(s, moves)
    want, z_all, pairs = np.zeros((6, 2)), 0.0, np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights = {}
        for y in np.ndindex(*[2] * len(at)):
            weights[y] = math.exp(sum(s[i, v] for i, v in zip(at, y)) + sum(moves[u, v] for u, v in zip(y, y[1:])))
        z = sum(weights.values())
        z_all += math.log(z)
        for y, w in weights.items():
            for i, v in zip(at, y):
                want[i, v] += w / z
            for u, v in zip(y, y[1:]):
                pairs[u, v] += w / z
    assert np.allclose(p, want) and np.allclose(expected, pairs) and abs(log_z - z_all) < 1e-9


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out, digits = [], lambda x: re.sub("[^0-9]", "", x)
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "phone": 10 <= len(digits(m[0])) <= 15,
                  "card": 14 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m[0])))) % 10 == 0}[k]
            out += [(m.start(), list(PATTERNS).index(k), m.end())] if ok else []
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(out))


@settings(max_examples=150, deadline=None)
@drawn(st.text(alphabet="a@.-1 29+()%", max_size=60))
def test_plain_spans_equal_the_patterns(text):
    assert deobfuscation.listed(deobfuscation.plain(text)) == brute_spans(text)


def test_deobfuscation_query(spark, given):
    found = {r.doc_id: r for r in QUERIES["op4_deobfuscation"](spark, SF).collect()}
    for d, t in given:
        want = brute_spans(t)
        assert found[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(found[d].spans.split(","))
        assert [found[d][f"n_{k}"] for k in PATTERNS] == [want.count(k) for k in PATTERNS]


@pytest.mark.parametrize("text, want", [
    ("mail john [at] example (dot) com now", ["john [at] example (dot) com"]), ("john dot doe at example dot com ok", ["john dot doe at example dot com"]),
    ("call plus one five five five one two three four five six seven", ["plus one five five five one two three four five six seven"]),
    ("x one nine two dot one six eight dot one dot one y", ["one nine two dot one six eight dot one dot one"]),
    ("ｊｏｈｎ＠example．com", ["ｊｏｈｎ＠example．com"]), ("аbc@exаmple.com", ["аbc@exаmple.com"]), ("me@ex​ample.org", ["me@ex​ample.org"]),
    ("look at the dot on the page at noon", []), ("one two three four cats at 10.30", [])])
def test_disguises_map_back(text, want):
    maps_back(text, want)


def maps_back(text, want):
    base, both = deobfuscation.spans(text)
    got = sorted((a, text[a:b]) for v in both.values() for a, b in v)
    assert [x for _, x in got] == want
    assert all(set(base[k]) <= set(both[k]) for k in base)


@pytest.mark.parametrize("at", ["@", " at ", "  AT\n", " @ ", "(at)", " [at] ", "{ @ }", "<At>"])
@pytest.mark.parametrize("dot", [".", " dot ", " Dot  ", " . ", "(dot)", " [.] ", "{ dot }"])
@pytest.mark.parametrize("inner", [".", " dot ", "[dot]"])
def test_every_pair_of_disguises(at, dot, inner):
    address = f"jane{inner}doe{at}mail{dot}example{dot}com"
    plain = (at, dot) == ("@", ".")
    base = len(deobfuscation.plain(address)["email"])
    got = deobfuscation.spans(f"Email: {address}, soon")[1]["email"]
    # An address whose host is plain is a base span; its local part is not changed.
    assert got == ([(7, 7 + len(address))] if not plain or inner == "." else [(7 + len("jane" + inner), 7 + len(address))]) and base == plain


@pytest.mark.parametrize("text", ["look at example.com today", "see it at evil[.]com", "email us at example.com", "she worked at a dot com firm", "arrived at the dot on the map",
                                  "met at noon . It rained", "at 10.30 or at 5.pm", "x@ y dot com", "@home dot com", "at dot com", "[at] example dot com"])
def test_prose_is_no_address(text):
    maps_back(text, [])


@pytest.mark.parametrize("text, want", [
    ("jane at example.com", ["jane at example.com"]), ("From: bob at lists.example.org (Bob)", ["bob at lists.example.org"]), ("ask (bob at site.org) now", ["bob at site.org"]),
    ("jane at example dot se", ["jane at example dot se"]), ("five point six point seven point eight", ["five point six point seven point eight"]),
    ("10 dot 0 dot 0 dot 1, 10[.]1[.]2[.]3", ["10 dot 0 dot 0 dot 1", "10[.]1[.]2[.]3"]), ("a@b dot com, c at d dot org; e[at]f.net", ["a@b dot com", "c at d dot org", "e[at]f.net"])])
def test_mixed_disguises(text, want):
    maps_back(text, want)


@pytest.mark.parametrize("text", [" " * 300_000 + "at x dot com", "a dot " * 50_000, " at a" * 50_000, "at dot " * 50_000, "[ " * 100_000, "a." * 100_000 + "b at c dot com", "one" + " " * 300_000])
def test_disguise_scans_are_linear(text):
    began = time.perf_counter()
    deobfuscation.spans(text)
    assert time.perf_counter() - began < 20


def test_redaction(odd, nothing):
    found = deobfuscation.redacted(odd)
    assert found.columns == odd.columns and found.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    rows = {(r.doc_id, r.text) for r in found.collect()}
    assert (10, "don't mail [EMAIL]\n\ndon't call [PHONE]") in rows and (1, None) in rows and (2**62 + 1, "é ü 中文 \x00 end") in rows
    assert deobfuscation.redacted(nothing).count() == deobfuscation.found(nothing).count() == 0
    assert deobfuscation.found(odd).count() == odd.count()
    assert len(deobfuscation.plain("1" * 200_000 + "." + "a" * 200_000)["ip"]) == 0


def test_labels_frame_is_not_needed_whole():
    assert pd.Series(line_crf.NAMES).is_unique
