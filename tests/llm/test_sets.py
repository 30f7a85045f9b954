"""Groups, windows, shards, packs, token files and pages against plain Python."""

import html
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import compare, duck
from cohortflow.llm import decontamination, near_dedup, packing, separators, slots, wrappers
from cohortflow.llm.queries import QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"
BPE = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    ok, note = compare(QUERIES[name](spark, SF), duck(SF), SQL[name])
    assert ok, note


def test_native_queries_have_no_python(spark):
    for name in ("op6_simhash_windows", "op7_virtual_slots"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def shingle_set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_components(rows, percent=85):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return [(d, len(s), d if not s else min(ids[root(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def keyed(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_forest_odd_rows(odd, nothing):
    found = near_dedup.components(odd).collect()
    assert keyed(map(tuple, found)) == keyed(brute_components([(r.doc_id, r.text) for r in odd.collect()]))
    assert near_dedup.components(nothing).count() == 0
    stay = near_dedup.one_of_each(odd)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None and r.text and r.text.strip()) == [4, 5, 8, 10, 2**62 + 1]


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Rows are told apart by id and set: unrelated texts stay whatever their ids, copies go whatever theirs."""
    text = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    near = lambda x: text(x) + " end"
    rows = [(1, text("a"), "stays"), (None, text("b"), "stays"), (None, text("c"), "stays"), (None, near("c"), "b or c"), (None, near("a"), "goes"),
            (5, text("d"), "stays"), (5, text("e"), "stays"), (5, text("a"), "goes"), (5, text("e"), "copy"), (6, near("d"), "goes"),
            (7, text("f"), "stays"), (None, text("f"), "goes"), (None, None, "empty"), (None, "", "empty"), (8, "", "empty"), (8, " ", "empty"), (9, text("g"), "stays"), (9, near("g"), "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(4)
    stay = near_dedup.one_of_each(docs).collect()
    assert sorted((r.text or "")[:1].strip() for r in stay) == ["", "", "", "", *"abcdefg"]
    assert not [r for r in stay if r.note == "goes"]
    found = near_dedup.components(docs).collect()
    assert keyed(map(tuple, found)) == keyed(brute_components([r[:2] for r in rows]))


def test_forest_chains_and_crowds(spark, partitions):
    """A crowd of near copies, copies of its members, and chains whose ends are not alike; several partitions."""
    partitions(13)
    rng = np.random.default_rng(3)
    base = [f"a{i}" for i in range(260)]
    rows = []
    for _ in range(150):
        w = list(base)
        for at in rng.integers(0, 260, 3):
            w[at] = f"b{rng.integers(10**6)}"
        rows.append(" ".join(w))
    rows += rows[:40]
    for chain in range(4):
        w = [f"c{chain}x{i}" for i in range(300)]
        for step in range(12):
            w[step * 20] = f"d{chain}x{step}"
            rows.append(" ".join(w))
    rows += [" ".join(f"e{rng.integers(500)}" for _ in range(120)) for _ in range(100)]
    order = rng.permutation(len(rows))
    data = [(int(i), rows[j]) for i, j in enumerate(order)]
    docs, want = spark.createDataFrame(data, "doc_id long, text string").repartition(7), keyed(brute_components(data))
    for crowd in (256, 5):  # whole regions; crowded ones, whose strays are found at the end
        assert keyed(map(tuple, near_dedup.components(docs, crowd=crowd).collect())) == want


def test_edges_of_partitions_meet(spark, partitions):
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2 * 50, i // 2 * 50 + 50))) for i in range(40)]
    for n in (1, 9, 40):
        partitions(n)
        found = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.component_id == r.doc_id // 2 * 2 for r in found)



def test_uniting_takes_few_tables(spark, monkeypatch):
    """Long chains unite in the same few writes as short ones; many tasks find the same as one."""
    rng = random.Random(5)
    nodes = rng.sample(range(10**6), 120)
    links = [(min(p), max(p)) for p in list(zip(nodes[:70], nodes[1:70])) + [tuple(rng.sample(nodes[70:], 2)) for _ in range(30)]]
    own = {v: (rng.random() < 0.2, rng.randrange(50), v) for v in nodes}  # ids repeat, some nodes have none
    want = dict(own)
    while True:
        before = dict(want)
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    labels = spark.createDataFrame([(v, own[v]) for v in nodes], "node long, label struct<no_id: boolean, id: long, node: long>")
    found = spark.createDataFrame(links, "a long, b long")
    writes, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name="table": writes.append(name) or write(df, name))
    assert {r.node: tuple(r.label) for r in near_dedup.united(labels, found).collect()} == want
    assert len(writes) <= 3
    assert {r.node: tuple(r.label) for r in near_dedup.united(labels, found, most=20).collect()} == want
    assert {r.node: tuple(r.label) for r in near_dedup.united(labels, found.limit(0)).collect()} == own


def test_clashing_names(spark, odd):
    """Columns with the names that the operators use for themselves."""
    docs = odd.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("__id", "__node", "__its", "__TH", "label", "stays"))])
    kept = near_dedup.one_of_each(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns) and sorted(map(tuple, (r[:2] for r in kept)), key=str) == sorted(
        map(tuple, near_dedup.one_of_each(odd.select("doc_id", "text")).collect()), key=str)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    assert decontamination.clean(docs, items).columns == docs.columns
    assert decontamination.clean(docs, items).count() == odd.count() - 4


def words(t):
    return (t or "").lower().split()


def grams(w):
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute_hits(docs, items):
    held = {i: grams(words(t)) for i, t in items if words(t)}
    df = Counter(s for v in held.values() for s in set(v))
    weight = lambda s: log(1 + len(held) / df.get(s, 1)) if s in df else log(1 + len(held))
    size = {i: len(words(t)) for i, t in items}
    out = set()
    for d, t in docs:
        w = words(t)
        own = set(grams(w))
        for i, v in held.items():
            if own.isdisjoint(v) or (len(w) >= 5) != (size[i] >= 5):
                continue
            c, best = Counter(v), 0.0
            for a in range(max(1, len(w) - size[i] + 1)):
                x = Counter(grams(w[a:a + size[i]]))
                low = sum(weight(s) * min(n, c[s]) for s, n in x.items())
                best = max(best, low / (sum(weight(s) * n for s, n in x.items()) + sum(weight(s) * n for s, n in c.items()) - low))
            if best >= 0.8 - 1e-12:
                out.add((d, i))
    return out


def test_decontamination_query(spark, given):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = QUERIES["op6_simhash_windows"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_hits(given, items) and len(found) == len({(r.doc_id, r.item_id) for r in found})


def test_decontamination_cases(spark, odd, nothing):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(40)]
    edited = list(passage)
    edited[20] = "changed"
    noise = lambda n: [f"n{rng.integers(10**6)}" for _ in range(n)]
    docs = [(1, " ".join(noise(50) + passage + noise(70))), (2, " ".join(noise(9) + edited + noise(3))), (3, " ".join(noise(50) + passage[:20] + noise(50))),
            (4, " ".join(passage)), (5, " ".join(noise(30))), (6, "A  b\nC"), (7, "a b c d e f g"), (8, None), (9, ""), (10, " ".join(passage + passage)),
            (11, " ".join(passage[:30])), (12, " ".join(noise(50) + passage + noise(70)))]
    items = [(1, " ".join(passage)), (2, " ".join(passage)), (3, "a b c"), (4, None), (5, ""), (None, "x y z"), (6, " ".join(noise(30)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.matches(d, i).collect()}
    assert set(found) == brute_hits(docs, [x for x in items if x[0] is not None])
    assert found[1, 1].start == 50 and found[1, 2].n_words == 40 and abs(found[4, 1].similarity - 1) < 1e-9 and (6, 3) in found
    assert {r.doc_id for r in decontamination.clean(d, i).collect()} == {x[0] for x in docs} - {x for x, _ in found}
    assert decontamination.clean(odd, i).columns == odd.columns and decontamination.clean(odd, i).count() == odd.count()
    assert decontamination.matches(nothing, i).count() == decontamination.matches(d, i.limit(0)).count() == 0


def test_hamming_search_is_complete(spark):
    rng = np.random.default_rng(7)
    items = [(i, int(rng.integers(-2**63, 2**63 - 1))) for i in range(30)]
    prints = []
    for _, p in items:
        for far in (0, 5, 15, 19, 20, 25):
            x = p
            for b in rng.permutation(64)[:far].tolist():
                x ^= (1 << b) if b < 63 else -(1 << 63)
            prints.append(x)
    got = {(r.print, r.item_id) for r in decontamination.within(spark.createDataFrame([(p,) for p in prints], "print long"), spark.createDataFrame(items, "item_id long, item_print long")).collect()}
    assert got == {(p, i) for p in prints for i, x in items if ((p ^ x) & (2**64 - 1)).bit_count() <= 19}


def test_slots_query(spark, given):
    found = QUERIES["op7_virtual_slots"](spark, SF).collect()
    text = dict(given)
    assert sorted(r.doc_id for r in found) == sorted(text)
    shards = defaultdict(list)
    for r in found:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        shards[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_slots_balance_and_rebalance(spark, odd, nothing):
    rng = np.random.default_rng(2)
    sizes = spark.createDataFrame([(i, int(b), 1) for i, b in enumerate(rng.integers(1, 10**6, 600))], "virtual_slot int, bytes long, rows long")
    first = slots.first_map(sizes, 7)
    load = lambda m: [r.b for r in m.join(sizes, "virtual_slot").groupBy("shard").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "b").collect()]
    assert first.count() == 600 and max(load(first)) < 1.01 * min(load(first))
    for n in (8, 6):
        again = slots.rebalanced(sizes, first, n)
        assert again.count() == 600 and len(load(again)) == n and max(load(again)) < 1.05 * min(load(again))
        moved = again.join(first.withColumnRenamed("shard", "old"), "virtual_slot").where("shard <> old").count()
        assert moved < 600 / 5
    rows = slots.records(odd)
    per = slots.slot_sizes(rows)
    placed = slots.place(rows, slots.first_map(per, 3), per).collect()
    assert len(placed) == odd.count()
    for s in range(3):
        mine = sorted(r.slot for r in placed if r.shard == s)
        assert mine == list(range(len(mine)))
    rows = slots.records(nothing)
    assert slots.place(rows, slots.first_map(slots.slot_sizes(rows), 3), slots.slot_sizes(rows)).count() == 0


def test_maps_are_versions(spark, tmp_path):
    m = spark.createDataFrame([(0, 1), (1, 0)], "virtual_slot int, shard int")
    slots.save_map(m, str(tmp_path), 1)
    assert slots.save_map(m, str(tmp_path), 2).count() == 2
    with pytest.raises(Exception, match="exist"):
        slots.save_map(m, str(tmp_path), 1)


def packed_right(rows, found, window=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (d, ids), n in want.items():
        if sum(k[0] == d for k in want) > 1 or n > 1:  # repeated ids: the pieces of several documents, checked by their number
            continue
        at = 0
        for r in sorted(docs[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert 0 < at <= window
    return sequences


def test_packing_query(spark, given):
    sequences = packed_right(given, QUERIES["op8_nnls_packing"](spark, SF).collect())
    assert sum(sum(x for _, x in v) < 1024 for v in sequences.values()) <= 1


def test_packing_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    packed_right(rows, packing.pack(odd, BPE).collect())
    packed_right(rows, packing.pack(odd.repartition(5), BPE, window=64).collect(), 64)
    assert packing.pack(nothing, BPE).count() == 0


def test_packing_added_tokens(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"don't{end}stop {end[:-1]} {end}", "plain text", "", f"x  {end}\n{end}  y", None, f"<{end}>" * 700]
    rows = [(i, t) for i, t in enumerate(texts)]
    packed_right(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BPE).collect())


def test_packing_plan_uses_what_is_there():
    rng = np.random.default_rng(4)
    hist = np.bincount(rng.integers(1, 1024, 20_000), minlength=1024)
    table, used, sequences = packing.plan(hist)
    assert (used <= hist).all() and used.sum() > 0.8 * hist.sum()
    ids = 0
    for length, ranges in table.items():
        at = 0
        for lo, hi, _, n, _ in ranges:
            assert lo == at and (hi - lo) % n == 0
            at, ids = hi, ids + (hi - lo) * length
        assert at == used[length]
    assert ids == 1024 * sequences


def test_separator_scan(spark, given, odd, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    found = {r.doc_id: r.n_tokens for r in QUERIES["op5_separator_scan"](spark, SF).collect()}
    assert found == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in given}
    for block, group in ((7, 3), (64, 2), (1 << 16, 4096)):
        blocks, manifest = separators.flat_files(odd.repartition(3), BPE, block=block)
        both = separators.documents(separators.searched(blocks), group).join(manifest, ["file", "doc_no"], "full").collect()
        assert sorted(r.n_tokens for r in both) == sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    blocks, _ = separators.flat_files(nothing, BPE)
    assert separators.documents(separators.searched(blocks)).count() == 0


def test_raw_token_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    want = {}
    for name in "ab":
        ids = rng.integers(0, 40, 1000).astype("<u2")
        ids.tofile(tmp_path / f"{name}.bin")
        ends = np.flatnonzero(ids == 3)
        cuts = np.concatenate([[0], ends + 1, [] if ends[-1] == 999 else [1000]]).astype(int)
        want[name] = [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]
    (tmp_path / "empty.bin").write_bytes(b"")
    found = separators.documents(separators.searched(separators.blocks_of(spark, str(tmp_path), 32), 3), 4).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r.doc_no):
        got[r.file[-5]].append((r.start, r.n_tokens))
    assert dict(got) == want


def article(page):
    inside = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside))
    return "\n\n".join(x for x in blocks if x)


def test_wrappers_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_wrappers"](spark, SF).collect():
        want = article(pages[r.page_id].html)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_wrappers_without_article(spark):
    """Fixed text beside the slots is left out where a host has no article; menus of any length fold."""
    rows = []
    for i in range(12):
        menu = "".join(f"<li><a href=x>m{i}{k}</a></li>" for k in range(1 + i % 4))
        extra = "<h2>Sub &amp; title</h2>" if i % 3 == 0 else ""
        rows.append((i, "http://h.example/x", f"<html><body><ul class='menu'>{menu}</ul><div id=c><h4>Fixed line here</h4>{extra}<p>Text number {i} &lt;b&gt; with\n  words</p>"
                     f"<div class='comments'><p>comment {i}</p></div></div><div class=foot><p>Fixed foot</p></div><script>if (a < b) {{ '<p>' }}</script></body></html>"))
    rows += [(20, "http://one.example/", "<div><p>alone</p></div>"), (21, None, None), (22, "http://h.example/", ""), (23, "bad url", "plain <b>text</b> & more <"),
             (24, "http://a.example", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>")]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert f"Text number {i} <b> with words" in found[i] and not re.search("comment|m1|Fixed|if", found[i]), found[i]
    assert "Sub & title" in found[0]
    assert found[20] == "alone" and found[21] == found[22] == "" and found[23].startswith("plain text & more") and found[24] == "deep"
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == before.columns and docs.schema.names == before.schema.names
        rows, had = docs.collect(), [(r.doc_id, r.text) for r in before.collect()]
        ids = {r.doc_id for r in rows}
        if name == "near_dedup":
            assert ids == {d for d, n, c in brute_components(had) if d == c}
        elif name == "decontaminate":
            assert ids == {d for d, _ in had} - {d for d, _ in brute_hits(had, items)}
        elif name == "personal_data":
            assert ids == {d for d, _ in had} and all(r.n_chars == len(r.text) for r in rows)
        elif name == "pack":
            packed_right(had, rows)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def wrapped(pages):
    """Main texts by the wrapper of all pages."""
    wrapper = None
    for page in pages:
        nodes = wrappers.of_page(wrappers.stream(page))[0]
        wrapper = nodes if wrapper is None else wrappers.merged(wrapper, nodes)
    return [wrappers.main_text(p, wrapper, wrappers.main_path(wrapper)) for p in pages]


def test_wrapper_compares_whole_texts():
    """Paragraphs that start alike for 200 characters are no template text."""
    lead = "From our correspondent in the capital, all rights reserved. " * 5
    pages = [f"<body><div class='x'><p>{lead}{w} news of the day</p></div><div class='y'>Fixed words</div></body>" for w in ("Good", "Bad", "Odd")]
    assert wrapped(pages) == [f"{lead}{w} news of the day" for w in ("Good", "Bad", "Odd")]


def test_wrapper_sees_deep_containers():
    deep = "<div>" * 70
    pages = [f"<body>{deep}<nav>menu {i}</nav><article><p>text {i}</p><div class='sidebar'>side {i}</div></article></div><p>after {i}</p></body>" for i in range(3)]
    assert wrapped(pages) == [f"text {i}" for i in range(3)]


def test_wrapper_of_two_templates():
    """Both templates of a host keep their texts; a page of menus and fixed text has none."""
    story = lambda i: f"story {i} " + f"w{i} " * 40
    one = [f"<body><nav>Menu</nav><div class='story'><p>{story(i)}</p></div><div class='low'>Fixed</div></body>" for i in range(6)]
    two = [f"<body><nav>Menu</nav><section class='blog'><div class='entry'><p>{story(i)}</p></div></section><div class='low'>Fixed</div></body>" for i in range(6, 10)]
    bare = "<body><nav>Menu</nav><div class='low'>Fixed</div></body>"
    assert wrapped([*one, *two, bare]) == [*(story(i).strip() for i in range(10)), ""]


@pytest.mark.parametrize("outer", ["<body class='has-sidebar'><div>", "<body><div class='content-with-sidebar'>", "<body><article class='post no-comments'>", "<body id='share'><div>"])
def test_wrapper_class_words_rule_out_what_they_name(outer):
    pages = [f"{outer}<p>text {i} of the page</p><div class='post-comments'>c{i}</div></div></article></body>" for i in range(3)]
    got = wrapped(pages)
    assert all(f"text {i} of the page" in x for i, x in enumerate(got))
    assert outer.startswith("<body id") or got == [f"text {i} of the page" for i in range(3)]
