"""Ranked search, spelling variants and archives against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortflow.llm import legacy_archives, reversed_search, spelling
from cohortflow.session import new_path


# ---- ranked search ----------------------------------------------------------------------------------------------------

def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_search(docs, items, best=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    docs = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs]
    docs = [x for x in docs if x[2]]
    n_docs, n_terms = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, counts, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(reps * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                        for t, reps in Counter(cut(text)).items() if t in counts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def searched(docs, items, **how):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in reversed_search.search(docs, items, **how).collect()), key=str)


ITEMS = [(1, "One two THREE, three; w5x5"), (2, None), (3, ""), (4, "é ü 中文 don't"), (4, "é ü 中文 don't"), (5, "nowhere"), (None, "short"), (5, "mail one")]


def test_search_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(*x, "n") for x in ITEMS], "item_id long, text string, term string")
    want = brute_search([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], ITEMS)
    assert searched(odd, items) == want
    assert searched(odd.repartition(5), items, postings=3, block_items=1) == want  # an index in several blocks
    assert searched(nothing, items) == [] == searched(odd, items.limit(0)) == searched(odd.where("text IS NULL"), items)


def test_search_of_copies_and_few_scores_at_once(spark, monkeypatch):
    docs = [(i, "alpha beta gamma " + "delta " * (i % 3)) for i in range(400)] + [(None, "alpha beta gamma ")] * 3 + [(7, "alpha")]
    random.Random(3).shuffle(docs)
    items = [(1, "alpha delta"), (2, "gamma gamma"), (3, "delta")]
    monkeypatch.setattr(reversed_search, "CELLS", 24)
    monkeypatch.setattr(reversed_search, "GROUPS", 2)
    monkeypatch.setattr(reversed_search, "PIECE", 7)
    got = searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute_search(docs, items)


def test_heaps_keep_the_best():
    rng = np.random.default_rng(5)
    kept, seen = reversed_search.Heaps(4, 3), []
    for _ in range(30):
        scores, doc, null = rng.integers(0, 6, (rng.integers(1, 9), 4)), None, None
        doc, null = rng.integers(0, 50, len(scores)), rng.random(len(scores)) < 0.2
        kept.add(scores, doc, null)
        seen += [(j, -s, n, d) for row, d, n in zip(scores.tolist(), doc.tolist(), null.tolist()) for j, s in enumerate(row) if s > 0]
    want = [x for j in range(4) for x in sorted(s for s in seen if s[0] == j)[:3]]
    assert sorted(zip(kept.item.tolist(), (-kept.score).tolist(), kept.null.tolist(), kept.doc.tolist())) == want


# ---- spelling variants ------------------------------------------------------------------------------------------------

def brute_counts(docs):
    counts = Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            counts[word[:h % len(word)] + word[h % len(word) + 1:] if h % 31 == 0 else word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(counts):
    places = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            places[i, w[:i] + w[i + 1:]].add(w)
    near = {w: {x for i in range(len(w)) for x in places[i, w[:i] + w[i + 1:]]} - {w} for w in counts}
    for w in counts:
        for shorter in {w[:i] + w[i + 1:] for i in range(len(w))} & counts.keys():
            near[w].add(shorter)
            near[shorter].add(w)
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def found_variants(df, **how):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df, **how).collect())


@pytest.fixture(scope="module")
def misspelt():
    """Words with chains of ever rarer variants, anagrams that no tree can part, and accents."""
    rng = random.Random(11)
    texts = []
    for i in range(60):
        word = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(7, 10)))
        n = 2000
        while n >= 2:
            texts += [word] * n
            n //= rng.choice([10, 12, 5])
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", "x", "a" + word[at]]) + word[at + 1:]
    letters = list("abcdefgh")
    for _ in range(300):
        rng.shuffle(letters)
        texts += ["".join(letters), "".join(letters).upper()]
    rng.shuffle(texts)
    return [(i if i % 50 else None, " ".join(texts[i * 40:i * 40 + 40])) for i in range(len(texts) // 40 + 1)]


@pytest.mark.parametrize("how", [{}, {"leaf": 5, "sample": 200, "own": 40, "asked": 150}, {"sample": 1}])
def test_variants_equal_brute_force(spark, misspelt, how):
    df = spark.createDataFrame(misspelt, "doc_id long, text string").repartition(5)
    want = brute_variants(brute_counts(misspelt))
    assert found_variants(df, **how) == want and sum(r[1] != r[2] and r[1] is not None for r in want) > 5


def test_variants_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found_variants(odd) == brute_variants(brute_counts(rows))
    assert found_variants(nothing) == []


def test_box_search_is_complete():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (500, spelling.LETTERS)) * (rng.random((500, spelling.LETTERS)) < 0.1)
    v = v.astype(np.int16)
    tree = spelling.Tree(v, 4)
    assert tree.leaves > 50 and (tree.place(v) == np.concatenate([np.full(len(r), i) for i, r in enumerate(tree.rows)])[np.argsort(np.concatenate(tree.rows))]).all()
    for up, down in ((1, 1), (1, 0), (2, 2)):
        row, leaf = tree.within(v, up, down)
        reached = set(zip(row.tolist(), leaf.tolist()))
        gap = v[None, :, :].astype(int) - v[:, None, :]
        close = (np.maximum(gap, 0).sum(axis=2) <= up) & (np.maximum(-gap, 0).sum(axis=2) <= down)
        leaves = tree.place(v)
        assert all((i, int(leaves[j])) in reached for i, j in zip(*np.nonzero(close)))
        assert len(reached) < len(v) * tree.leaves / 2


def test_a_long_text_is_cut_after_runs(spark):
    text = "prefixed " + "abcdefgh" * 300_000 + " suffixed suffixed prefixed"
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    want = Counter()
    for word in text.split():
        h = zlib.crc32(f"1:{word}".encode())
        want[word[:h % len(word)] + word[h % len(word) + 1:] if h % 31 == 0 else word] += 1
    assert got == want


# ---- archives ---------------------------------------------------------------------------------------------------------

def brute_pages(rows):
    """Rows as the records of one file in order; equal ids stay in order."""
    data = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in data:
        if len(p) >= 100:
            first[p] = min(first.get(p, (True, 0)), (i is None, i or 0))
    out, used = [], set()
    for i, p in data:
        again = len(p) >= 100 and ((i is None, i or 0) != first[p] or p in used)
        if len(p) >= 100 and (i is None, i or 0) == first[p]:
            used.add(p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", (None if first[p][0] else first[p][1]) if again else None))
    return sorted(out, key=str)


def got_pages(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


PAGES = [(5, "http://a/ b c\nd", "x" * 99), (3, "http://a", "x" * 99), (9, None, "<p>é\r\n\r\nWARC/1.1\r\n" * 30), (4, "", "<p>é\r\n\r\nWARC/1.1\r\n" * 30),
         (4, "http://é", "<p>é\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "<p>é\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "n" * 200), (None, "u", "n" * 200),
         (7, "u", None), (8, "u", ""), (2**62, "filedesc://x", "\n1 0 x\n" * 40_000), (1, "u", "\x00" * 150)]


def test_archives_odd_rows(spark):
    df = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, path string, at int")
    assert got_pages(legacy_archives.round_trip(df.coalesce(1))) == brute_pages([(p[0], p[2]) for p in PAGES])
    assert got_pages(legacy_archives.round_trip(df.limit(0))) == []


def test_archives_in_small_files_with_crowded_payloads(spark):
    rows = [(i, f"http://h/{i}", "copy " * 40 if i % 3 else f"page {i} " * 30) for i in range(500, 0, -1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    legacy_archives.write_arc(df, arcs, per_file=20)
    legacy_archives.convert(spark, arcs, warcs, per_file=20, crowded=100)
    files = legacy_archives.archives(spark, arcs).select("path", "content").collect()
    assert len(files) >= 500 / 19
    versions = {legacy_archives.plain(bytes(f.content)).split(b"\n")[1][:1] for f in files}
    assert versions == {b"1", b"2"}
    records = legacy_archives.read_warc(legacy_archives.archives(spark, warcs)).cache()
    assert records.select("record_id").distinct().count() == 500
    assert {r.target_uri for r in records.collect()} == {r[1] for r in rows} and {r.date for r in records.collect()} == {"2001-02-03T04:05:06Z"}
    assert got_pages(legacy_archives.page_records(records, crowded=100)) == brute_pages([(r[0], r[2]) for r in rows])
    again = new_path(spark, "warc")
    legacy_archives.convert(spark, arcs, again, per_file=7)
    assert records.exceptAll(legacy_archives.read_warc(legacy_archives.archives(spark, again))).count() == 0  # ids are the same again


def test_archives_are_gzipped_at_the_fast_level(spark, tmp_path):
    """Which leaves most of the time to the records; the files are larger than at the usual level."""
    words = [f"word{i}" for i in range(300)]
    html = " ".join(random.Random(1).choices(words, k=60_000))
    pages = spark.createDataFrame([(1, "http://a", html)], "page_id long, url string, html string").coalesce(1)
    legacy_archives.write_arc(pages, str(tmp_path / "arc"))
    legacy_archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    for kind in ("arc", "warc"):
        (file,) = (f for f in (tmp_path / kind).glob("part-*") if f.stat().st_size > 1000)
        data = legacy_archives.plain(file.read_bytes())
        fast, usual = (len(zlib.compress(data, level)) for level in (1, 6))
        assert html.encode() in data
        assert abs(file.stat().st_size - fast) < abs(file.stat().st_size - usual)


def test_arc_versions_lengths_and_faults():
    one = legacy_archives.arc_file([(1, "http://a", b"\n\nbody\n"), (2, "http://b", b"")], 1, "x.arc", "1996")
    two = legacy_archives.arc_file([(1, "http://a", b"\n\nbody\n"), (2, "http://b", b"")], 2, "x.arc", "19960102")
    cut = [list(legacy_archives.arc_records(b"\n".join(x) + b"\n", "p")) for x in (one, two)]
    assert [[r[1:3] + r[4:] for r in x] for x in cut][0] == [r[1:3] + r[4:] for r in cut[1]] and cut[0][0][3] == "1996"
    assert legacy_archives.timestamp("1996") == "1996-01-01T00:00:00Z" and legacy_archives.timestamp("19960102") == "1996-01-02T00:00:00Z"
    assert [int(r.split(b"\n")[0].split(b" ")[7]) for r in two] == [b"\n".join(two).find(r) for r in two]  # declared offsets are true
    short = list(legacy_archives.arc_records((b"\n".join(one))[:-10], "p"))
    assert [r[6] for r in short] == [False, True]
    assert b"WARC-Truncated: unspecified" in legacy_archives.warc_of("p", short[1], None)
    dns = b"dns:host 1.2.3.4 19970101000000 text/dns 7\n1.2.3.4\n"
    (record,) = legacy_archives.arc_records(one[0] + b"\n" + dns, "p")
    assert legacy_archives.warc_of("p", record, None).startswith(b"WARC/1.1\r\nWARC-Type: resource")
    for bad in (b"http://a 0.0.0.0 1996 text/html 3\nabc\n", one[0] + b"\nhttp://a 1996 x\nabc\n"):
        with pytest.raises(ValueError):
            list(legacy_archives.arc_records(bad, "p"))


def test_damaged_warc_is_told():
    (f, block), = legacy_archives.warc_records(legacy_archives.warc_record("response", "urn:uuid:1", "d", b"abc", [], "t") + b"\r\n\r\n", "p")
    assert f["warc-record-id"] == "<urn:uuid:1>" and block == b"abc"
    with pytest.raises(ValueError):
        list(legacy_archives.warc_records(legacy_archives.warc_record("response", "urn:uuid:1", "d", b"abc", [], "t").replace(b"abc", b"abd") + b"\r\n\r\n", "p"))
