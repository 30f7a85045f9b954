"""Label lists, channel settings, digests of tables, reuse of computed columns."""

from __future__ import annotations


from pyspark.sql import functions as F

from cohortflow.session import new_path, written
from cohortflow.sources import digests, reuse
from cohortflow.sources.episodes import read_channels, read_listfile

from .base import OBS, query, r6, stay_labels, table


@query("label_lists", f"""WITH {OBS}
SELECT stay_id, round(t, 6) AS t, y AS mortality, 1 - y AS decompensation, round(t / 24, 6) AS los, CAST(13 * (1 - y) + 12 * y AS BIGINT) AS phenotypes,
       y AS ihm_label, 1 AS los_mask, round(t / 2, 6) AS los_last, 2 AS n_pheno, 1 - y AS decomp_last FROM stays""")
def label_lists(spark, sf):
    """Lists of all five layouts, written from the stays and read back."""
    stays = written(stay_labels(spark, sf).withColumn("stay_id", F.col("stay_id").cast("string")), "stays")
    y, t = F.col("y"), F.col("t")
    lists = {
        "mortality": [y],
        "decompensation": [t, (1 - y).alias("y")],
        "los": [t, (t / 24).alias("y")],
        "phenotyping": [t, *[((y + i) % 2).alias(f"y{i}") for i in range(1, 26)]],
        "multitask": [t, F.concat_ws(";", F.lit(1), y).alias("ihm"), F.concat_ws(";", F.lit(1), F.lit(0), t, t / 2).alias("los"),
                      F.concat_ws(";", y, 1 - y).alias("pheno"), F.concat_ws(";", F.lit(1), F.lit(1), y, 1 - y).alias("decomp")],
    }
    back = {}
    for task, columns in lists.items():
        path = new_path(spark, task)
        stays.select("stay_id", *columns).write.option("header", True).csv(path)
        back[task] = read_listfile(spark, path, task)
    out = back["multitask"].select("stay_id", r6("t"), F.col("ihm")[1].alias("ihm_label"), F.col("los.mask")[0].alias("los_mask"), r6(F.col("los.y")[1], "los_last"),
                                   F.size("pheno").alias("n_pheno"), F.col("decomp.y")[1].alias("decomp_last"))
    ones = F.aggregate("y", F.lit(0).cast("long"), lambda a, x: a + x)
    for task, value in (("mortality", F.col("y").alias("mortality")), ("decompensation", F.col("y").alias("decompensation")), ("los", r6("y", "los")),
                        ("phenotyping", ones.alias("phenotypes"))):
        out = out.join(back[task].select("stay_id", value), "stay_id")
    return out.withColumn("stay_id", F.col("stay_id").cast("long"))


@query("channel_settings", """
WITH c AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) - 1 AS idx, count(*) % 2 = 0 AS flag, CAST(count(*) AS VARCHAR) AS normal FROM events GROUP BY event_type)
SELECT 'channel' AS kind, name, CAST(idx AS DOUBLE) AS number, flag AS is_categorical, normal AS detail FROM c
UNION ALL SELECT 'code', r_name, CAST(n_nationkey AS DOUBLE), NULL, n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def channel_settings(spark, sf):
    """Both settings files, written from the given tables (one entry for each event type, region and nation) and read back."""
    config, codes = new_path(spark, "config"), new_path(spark, "codes")
    types = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    entry = lambda value: F.map_from_entries(F.collect_list(F.struct("event_type", value)))
    types.agg(F.array_sort(F.collect_list("event_type")).alias("id_to_channel"), entry(F.col("n") % 2 == 0).alias("is_categorical_channel"),
              entry(F.col("n").cast("string")).alias("normal_values")).write.json(config)
    of = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(
        F.struct(F.array_sort(F.collect_list("n_name")).alias("possible_values"), F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("int")))).alias("values")).alias("e"))
    of.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "e")))).alias("value")).write.text(codes)
    channels, labels = read_channels(spark, config, codes)
    return channels.select(F.lit("channel").alias("kind"), "name", F.col("idx").cast("double").alias("number"), "is_categorical", F.col("normal_value").alias("detail")).unionByName(
        labels.select(F.lit("code").alias("kind"), F.col("channel").alias("name"), F.col("code").alias("number"), F.lit(None).cast("boolean").alias("is_categorical"), F.col("label").alias("detail")))


_ID = "coalesce(CAST(doc_id AS VARCHAR), '')"
_ROWS = f"(SELECT lang, md5({_ID}) AS k, md5({_ID} || '|' || coalesce(md5(text), '')) AS h FROM documents)"
_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS {x}" for i, x in enumerate("abcd"))


@query("digest_ranges", f"SELECT substr(k, 1, 3) AS range, count(*) AS n, {_LANES} FROM {_ROWS} GROUP BY 1")
def digest_ranges(spark, sf):
    return digests.range_digests(table(spark, sf, "documents"), "doc_id", "text")


@query("digest_append", f"""
SELECT level, substr(k, 1, level) AS node, count(*) AS n, {_LANES}
FROM {_ROWS}, (VALUES (0), (1), (2), (3)) AS l(level) WHERE lang IS DISTINCT FROM 'de' GROUP BY 1, 2""")
def digest_append(spark, sf):
    """English texts are appended to the others and German ones removed; each part is read once, the tree is of sums."""
    docs = table(spark, sf, "documents")
    part = lambda rows: digests.range_digests(rows, "doc_id", "text")
    english, german = F.col("lang").eqNullSafe("en"), F.col("lang").eqNullSafe("de")
    first = written(part(docs.where(~english)), "digests")
    now = written(digests.merge_digests(first, part(docs.where(english)), less=part(docs.where(german))), "digests")
    return digests.digest_tree(now)


def revised(docs):
    """Another version of the documents: German texts changed, French ones gone, Spanish ones there a second time."""
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" rev"))).otherwise(F.col("text"))
    kept = docs.where(~F.col("lang").eqNullSafe("fr")).withColumn("text", text)
    return kept.unionByName(docs.where("lang = 'es'").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


@query("digest_changes", """
SELECT doc_id, 'changed' AS change FROM documents WHERE lang = 'de' AND text IS NOT NULL
UNION ALL SELECT doc_id, 'removed' FROM documents WHERE lang = 'fr'
UNION ALL SELECT doc_id + 1000000000, 'added' FROM documents WHERE lang = 'es'""")
def digest_changes(spark, sf):
    """Trees of two versions name the ranges that differ; only rows there are compared."""
    old = table(spark, sf, "documents")
    new = revised(old)
    was, now = (written(digests.digest_tree(digests.range_digests(t, "doc_id", "text")), "tree") for t in (old, new))
    ranges = written(digests.changed_ranges(was, now), "ranges")
    return digests.changed_rows(old, new, ranges, "doc_id", "text")


@query("partial_reuse", """
WITH now AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' rev' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr'
             UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE lang = 'es'),
old AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents)
SELECT doc_id, length(coalesce(now.text, '')) AS width, CASE WHEN old.text IS NULL THEN 2 ELSE 1 END AS run FROM now LEFT JOIN old ON coalesce(now.text, '') = old.text""")
def partial_reuse(spark, sf):
    """Columns are computed for all texts, then for those of a later version that the store lacks; ``run`` is the one that computed a row."""
    base, docs = new_path(spark, "store"), table(spark, sf, "documents")
    for run, version in enumerate((docs, revised(docs)), 1):
        reuse.fill(version, "text", base, lambda t, run=run: t.select(reuse.KEY, F.length("text").cast("long").alias("width"), F.lit(run).alias("run")))
    return reuse.with_stored(revised(docs).select("doc_id", "text"), "text", base).select("doc_id", "width", "run")
