"""Registered queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortflow.session import work_folder, written

from . import decontamination, deobfuscation, fertility, legacy_archives, line_crf, near_dedup, packing, reversed_search, separators, slots, spelling, suffix_tree, wrappers

SHARDS = 24
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_lsh_forest", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""")
def op10_lsh_forest(spark, sf_dir):
    """Components of near duplicates among all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_virtual_slots")
def op7_virtual_slots(spark, sf_dir):
    """All documents in 24 shards of near equal bytes, by a stored map of virtual slots."""
    rows = written(slots.records(table(spark, sf_dir, "documents")), "slot-rows")
    sizes = slots.slot_sizes(rows)
    maps = f"{work_folder(spark)}/cohortflow/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex}"
    slot_map = slots.save_map(slots.first_map(sizes, SHARDS), maps, 1)
    placed = slots.place(rows, slot_map, sizes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op8_nnls_packing")
def op8_nnls_packing(spark, sf_dir):
    """All documents packed into windows of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op1_suffix_tree")
def op1_suffix_tree(spark, sf_dir):
    """Log probabilities of all texts by a suffix tree learned from four fifths of them."""
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


@query("op2_fertility")
def op2_fertility(spark, sf_dir):
    """Fertility measures and verdicts of all documents."""
    found = fertility.measured(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return fertility.judged(written(found, "measured")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_piece", "chars_per_pair", "byte_share", "entropy")


@query("op4_deobfuscation")
def op4_deobfuscation(spark, sf_dir):
    """Plain and disguised identifiers of all documents."""
    return deobfuscation.found(table(spark, sf_dir, "documents"))


@query("op6_simhash_windows")
def op6_simhash_windows(spark, sf_dir):
    """Documents and benchmark items that match, with the place and the similarity."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_line_crf")
def op3_line_crf(spark, sf_dir):
    """Quality scores of all documents by a field over their lines."""
    return line_crf.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_wrappers")
def op9_wrappers(spark, sf_dir):
    """Main text of all pages by wrappers of their hosts."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query("op5_separator_scan")
def op5_separator_scan(spark, sf_dir):
    """Token counts of all documents, found in flat token files by their end ids."""
    blocks, manifest = separators.flat_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    found = separators.documents(written(separators.searched(blocks), "searched"))
    return found.join(manifest, ["file", "doc_no"], "left").select("doc_id", "file", "doc_no", "start", "n_tokens", "ended")


@query("op11_reversed_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS reps FROM i GROUP BY ALL),
a AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN a GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) CROSS JOIN a GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def op11_reversed_search(spark, sf_dir):
    """The ten documents that rank highest for each benchmark item."""
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling", r"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)),
        lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) AS h FROM o),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT d.word, x.word, x.n FROM del d JOIN words x ON d.rest = x.word UNION SELECT x.word, d.word, d.n FROM del d JOIN words x ON d.rest = x.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
f AS (SELECT words.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
      FROM words LEFT JOIN best ON best.word = words.word AND r = 1),
walk(word, root) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f AS last ON last.word = walk.root WHERE last.form IS NULL""")
def op12_spelling(spark, sf_dir):
    """Words of all documents with their near words, usual forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_legacy_archives", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100""")
def op13_legacy_archives(spark, sf_dir):
    """All pages in ARC files, converted to WARC files with revisits, and read back."""
    return legacy_archives.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
