"""Digests against plain Python, and the store of computed columns."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortflow.sources import digests, reuse

ROWS = [(None, "a"), (None, None), (1, ""), (1, None), (2, "x"), (2, "x"), (2, "x"), *[(i, f"text {i}") for i in range(3, 200)]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def brute(rows, digits=3):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = defaultdict(lambda: [0] * 5)
    for id_, text in rows:
        key = "" if id_ is None else str(id_)
        h = md5(f"{key}|{'' if text is None else md5(text)}")
        sums = out[md5(key)[:digits]]
        sums[0] += 1
        for i in range(4):
            sums[i + 1] = (sums[i + 1] + int(h[8 * i:8 * i + 8], 16)) % 2**32
    return {k: tuple(v) for k, v in out.items()}


def got(df, key="range"):
    return {r[key]: (r["n"], r["a"], r["b"], r["c"], r["d"]) for r in df.collect()}


def test_range_digests(spark):
    df = frame(spark, ROWS)
    assert got(digests.range_digests(df, "id", "text")) == brute(ROWS)
    assert got(digests.range_digests(df.repartition(13), "id", "text")) == brute(ROWS)
    assert got(digests.range_digests(frame(spark, []), "id", "text")) == {}


def test_appended_and_removed_rows(spark):
    one, two, gone = ROWS[:150], [(2, "x"), (500, "new")], ROWS[10:40]
    of = lambda rows: digests.range_digests(frame(spark, rows), "id", "text")
    left = list(one) + two
    for row in gone:
        left.remove(row)
    assert got(digests.merge_digests(of(one), of(two), less=of(gone))) == brute(left)
    assert got(digests.merge_digests(of(one), less=of(one))) == {}


def test_tree_is_of_prefixes(spark):
    tree = digests.digest_tree(digests.range_digests(frame(spark, ROWS), "id", "text"))
    for level in range(4):
        assert got(tree.where(F.col("level") == level), "node") == brute(ROWS, level)


def changes(spark, old, new):
    trees = [digests.digest_tree(digests.range_digests(frame(spark, t), "id", "text")) for t in (old, new)]
    ranges = digests.changed_ranges(*trees)
    found = digests.changed_rows(frame(spark, old), frame(spark, new), ranges, "id", "text")
    return {r["range"] for r in ranges.collect()}, {r["id"]: r["change"] for r in found.collect()}


def test_changes(spark):
    new = [r for r in ROWS if r[0] != 7] + [(900, "n"), (2, "x")]
    new[new.index((1, None))] = (1, "null no more")
    ranges, found = changes(spark, ROWS, new)
    assert found == {7: "removed", 900: "added", 2: "added", 1: "changed"}  # of a repeated row one more is there
    was, now = brute(ROWS), brute(new)
    assert ranges == {k for k in was.keys() | now.keys() if was.get(k) != now.get(k)}
    assert changes(spark, ROWS, ROWS[::-1]) == (set(), {})
    assert len(changes(spark, [], ROWS[:3])[1]) == 2 and changes(spark, [], []) == (set(), {})


def widths(asked):
    def compute(texts):
        asked.append({r["text"] for r in texts.collect()})
        return texts.select(reuse.KEY, F.length("text").alias("width"))

    return compute


def test_only_new_texts_are_computed(spark, tmp_path):
    base, asked = str(tmp_path / "store"), []
    with pytest.raises(ValueError, match="nothing is stored"):
        reuse.with_stored(frame(spark, ROWS), "text", base)
    assert reuse.fill(frame(spark, ROWS), "text", base, widths(asked)) == len({t or "" for _, t in ROWS})
    more = [*ROWS, (1000, "brand new"), (1001, "brand new")]
    assert reuse.fill(frame(spark, more), "text", base, widths(asked)) == 1 and asked[1] == {"brand new"}
    assert reuse.fill(frame(spark, more), "text", base, widths(asked)) == 0
    rows = reuse.with_stored(frame(spark, more), "text", base).collect()
    assert len(rows) == len(more) and all(r["width"] == len(r["text"] or "") for r in rows)
    with pytest.raises(ValueError, match="width"):
        reuse.with_stored(frame(spark, more).withColumn("width", F.lit(1)), "text", base)


def test_failed_jobs_leave_the_last_version(spark, tmp_path):
    base = str(tmp_path / "store")
    reuse.fill(frame(spark, ROWS[:20]), "text", base, widths([]))
    before = sorted(map(tuple, reuse.stored(spark, base).collect()))

    def broken(texts):
        return texts.select(reuse.KEY, F.when(F.col("text") == "text 30", F.raise_error(F.lit("broken"))).otherwise(F.length("text")).cast("int").alias("width"))

    with pytest.raises(Exception, match="broken"):
        reuse.fill(frame(spark, ROWS), "text", base, broken)
    assert sorted(map(tuple, reuse.stored(spark, base).collect())) == before
    reuse.fill(frame(spark, ROWS), "text", base, widths([]))
    reuse.compact(spark, base, frame(spark, ROWS[:20]))
    assert sorted(map(tuple, reuse.stored(spark, base).collect())) == before


def test_empty_tables_make_a_store(spark, tmp_path):
    base = str(tmp_path / "store")
    reuse.compact(spark, base)
    assert reuse.fill(frame(spark, []), "text", base, widths([])) == 0
    assert reuse.with_stored(frame(spark, ROWS[:3]), "text", base).where("width IS NULL").count() == 3
