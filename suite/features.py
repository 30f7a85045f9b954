"""Scalars, grids, masks, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import arrays, scalars
from cohortflow.operators import grids, splits
from cohortflow.plans import prepare

from .base import (CHANNELS, DAY, NORMALS, OBS, SEED, crowded_stays, floyd_sql, observations, query, r6, sql_hash, sql_uniform,
                   stay_labels, table)

PERIOD = 20  # slots of 24 hours
WHOLE = 32  # slots that hold all rows of the 30-day table


# ---- scalars -------------------------------------------------------------------------------------------------------

@query("leading_number", """
SELECT p_partkey, try_cast(nullif(regexp_extract(split_part(p_brand, '#', 2) || ' ' || p_type, '^\\s*(-?\\d+\\.?\\d*)', 1), '')
       AS DOUBLE) AS brand_no,
       try_cast(nullif(regexp_extract(' -' || CAST(p_retailprice AS VARCHAR) || 'x', '^\\s*(-?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS price,
       try_cast(nullif(regexp_extract(p_name, '^\\s*(-?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS nothing
FROM part""")
def leading_number(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        scalars.leading_number(F.concat(F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit(" "), "p_type")).alias("brand_no"),
        scalars.leading_number(F.concat(F.lit(" -"), F.col("p_retailprice").cast("string"), F.lit("x"))).alias("price"),
        scalars.leading_number(F.col("p_name")).alias("nothing"))


PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query("encode_category", """
SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS code FROM orders""")
def encode_category(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.encode_category(F.col("o_orderpriority"), PRIORITY_CODES).alias("code"))


@query("decode_category", """
SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber
         WHEN 1 THEN 'No Response' WHEN 2 THEN 'Abnormal Extension' WHEN 3 THEN 'Abnormal Flexion'
         WHEN 4 THEN 'Flex-withdraws' WHEN 5 THEN 'Localizes Pain' WHEN 6 THEN 'Obeys Commands'
         ELSE CAST(l_linenumber AS VARCHAR) || '.0' END AS motor,
       CASE WHEN l_quantity = 1 THEN 'No Response' WHEN l_quantity = 2 THEN 'To Pain' WHEN l_quantity = 3 THEN 'To Speech'
            WHEN l_quantity = 4 THEN 'Spontaneously' ELSE CAST(l_quantity AS VARCHAR) END AS eyes,
       CAST(l_quantity AS VARCHAR) AS plain
FROM lineitem""")
def decode_category(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        scalars.decode_category(F.lit("Glascow coma scale motor response"), F.col("l_linenumber").cast("double")).alias("motor"),
        scalars.decode_category(F.lit("Glascow coma scale eye opening"), F.col("l_quantity")).alias("eyes"),
        scalars.decode_category(F.lit("Glucose"), F.col("l_quantity")).alias("plain"))


@query("null_if_missing", """
WITH t AS (SELECT event_id, CASE WHEN value < 8 THEN '' WHEN value < 15 THEN 'NaN' WHEN value < 20 THEN ' None '
                                 WHEN value < 25 THEN ' x ' ELSE CAST(value AS VARCHAR) END AS cell FROM events)
SELECT event_id, CASE WHEN lower(trim(cell)) IN ('', 'nan', 'none') THEN NULL ELSE cell END AS cell FROM t""")
def null_if_missing(spark, sf):
    v = F.col("value")
    cell = (F.when(v < 8, "").when(v < 15, "NaN").when(v < 20, " None ").when(v < 25, " x ")
            .otherwise(v.cast("string")))
    return table(spark, sf, "events").select("event_id", scalars.null_if_missing(cell).alias("cell"))


@query("bucketize_los", f"""
WITH {OBS}
SELECT stay_id, row_no, CASE WHEN hours / 24 < 3 THEN 0 WHEN hours / 24 < 7 THEN 1 WHEN hours / 24 < 14 THEN 2 ELSE 3 END AS los,
       concat_ws(',', CAST(hours / 24 < 3 AS INTEGER), CAST(hours / 24 >= 3 AND hours / 24 < 7 AS INTEGER),
                 CAST(hours / 24 >= 7 AND hours / 24 < 14 AS INTEGER), CAST(hours / 24 >= 14 AS INTEGER)) AS one_hot
FROM obs""")
def bucketize_los(spark, sf):
    los = scalars.bucketize_los(F.col("hours"))
    return observations(spark, sf).select("stay_id", "row_no", los.alias("los"),
                                          F.array_join(scalars.one_hot(los, 4), ",").alias("one_hot"))


@query("label_letter", """
SELECT vec_id, CASE label WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE CAST(label AS VARCHAR) END AS letter,
       CASE WHEN label < 4 THEN label END AS back
FROM embeddings""")
def label_letter(spark, sf):
    letter = scalars.label_letter(F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", letter.alias("letter"), scalars.letter_label(letter).alias("back"))


def logits4():
    return F.slice(F.col("embedding"), 1, 4)


@query("softmax_risk", """
WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda z: CAST(z AS DOUBLE)) AS z FROM embeddings),
     e AS (SELECT vec_id, z, list_transform(z, lambda q: exp(q - list_max(z))) AS w FROM v),
     e2 AS (SELECT vec_id, exp(z[1] - greatest(z[1], z[2])) AS a, exp(z[2] - greatest(z[1], z[2])) AS b FROM v)
SELECT e.vec_id, round(w[1] / list_sum(w), 6) AS p0, round(w[4] / list_sum(w), 6) AS p3, round(b / (a + b), 6) AS risk,
       chr(CAST(64 + list_position(z, list_max(z)) AS INTEGER)) AS letter
FROM e JOIN e2 USING (vec_id)""")
def softmax_risk(spark, sf):
    sm = scalars.softmax(logits4())
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(F.element_at(sm, 1), "p0"), r6(F.element_at(sm, 4), "p3"),
        r6(scalars.risk(F.slice("embedding", 1, 2)), "risk"), scalars.argmax_letter(logits4()).alias("letter"))


@query("task_label", """
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS mortality, CAST(embedding[2] AS DOUBLE) AS los, CAST(embedding[3] AS DOUBLE) AS readmission
FROM embeddings""")
def task_label(spark, sf):
    labels = F.slice("embedding", 1, 3)
    return table(spark, sf, "embeddings").select(
        "vec_id", *[scalars.task_label(labels, t).cast("double").alias(t) for t in ("mortality", "los", "readmission")])


@query("reverse_los", "SELECT o_orderkey, round(o_totalprice * 2.5 + 10.0, 6) AS y FROM orders")
def reverse_los(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(scalars.reverse_los(F.col("o_totalprice"), 10.0, 2.5), "y"))


@query("time_list", f"""
WITH {OBS}
SELECT stay_id, string_agg(printf('%.2f', hours), ', ' ORDER BY row_no) AS times FROM obs GROUP BY stay_id""")
def time_list(spark, sf):
    rows = observations(spark, sf).groupBy("stay_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "hours"))).alias("h"))
    return rows.select("stay_id", scalars.time_list(F.transform("h", lambda s: s["hours"])).alias("times"))


@query("py_number", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       CAST(CAST(l_quantity * 1000000 AS BIGINT) AS VARCHAR) || '.0' AS large, CAST(l_extendedprice AS VARCHAR) AS middle,
       CASE WHEN l_tax = 0 THEN '0.0' ELSE '0.000' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) END AS small
FROM lineitem""")
def py_number(spark, sf):
    tax = F.round(F.col("l_tax") * 100)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        scalars.py_number(F.col("l_quantity") * 1000000.0).alias("large"),
        scalars.py_number(F.col("l_extendedprice")).alias("middle"),
        scalars.py_number(tax / F.lit(10000.0)).alias("small"))


@query("attention_map", """
SELECT vec_id, k AS name, CAST(v AS DOUBLE) AS score
FROM (SELECT vec_id, unnest(['click', 'error', 'purchase', 'demo']) AS k, unnest(embedding[1:4]) AS v FROM embeddings)""")
def attention_map(spark, sf):
    names = F.array(*[F.lit(c) for c in CHANNELS])
    return table(spark, sf, "embeddings").select(
        "vec_id", F.explode(scalars.attention_map(names, logits4().cast("array<double>"))).alias("name", "score"))


# ---- grids ---------------------------------------------------------------------------------------------------------

@query("smooth_hourly", f"""
WITH {OBS}, z AS (SELECT *, row_number() OVER (PARTITION BY stay_id, CAST(trunc(hours / 24) AS INTEGER) ORDER BY row_no DESC) AS rn FROM obs)
SELECT stay_id, row_no, round(hours, 6) AS hours, channel, raw FROM z WHERE rn = 1""")
def smooth_hourly(spark, sf):
    return grids.smooth_hourly(observations(spark, sf), "last", DAY).select(
        "stay_id", "row_no", r6("hours"), "channel", "raw")


CLIP = f"""{OBS},
flag AS (SELECT o.*, s.t, s.y, max(o.hours) OVER (PARTITION BY o.stay_id ORDER BY o.row_no) AS upto FROM obs o JOIN stays s USING (stay_id)),
clipped AS (SELECT stay_id, row_no, hours, channel, raw, t, y FROM flag WHERE upto <= t + 1e-6)"""


def _clipped(spark, sf):
    crowded = crowded_stays(spark, sf)
    return grids.clip_to_bound(observations(spark, sf, crowded), stay_labels(spark, sf), crowded)


@query("clip_to_bound", f"WITH {CLIP} SELECT stay_id, row_no, round(hours, 6) AS hours, channel, raw FROM clipped")
def clip_to_bound(spark, sf):
    return _clipped(spark, sf).select("stay_id", "row_no", r6("hours"), "channel", "raw")


@query("join_labels", f"""WITH {OBS}
SELECT channel, y, count(*) AS n, round(sum(raw), 6) AS total FROM obs JOIN stays USING (stay_id) GROUP BY channel, y""")
def join_labels(spark, sf):
    crowded = crowded_stays(spark, sf)
    joined = grids.join_labels(observations(spark, sf, crowded), stay_labels(spark, sf), crowded)
    return joined.groupBy("channel", "y").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("raw"), "total"))


@query("drop_empty", f"""
WITH {OBS}, early AS (SELECT DISTINCT stay_id FROM obs WHERE hours <= 3 AND raw IS NOT NULL)
SELECT count(*) FILTER (stay_id IN (SELECT stay_id FROM early)) AS n_kept,
       count(*) FILTER (stay_id NOT IN (SELECT stay_id FROM early)) AS n_skipped FROM stays""")
def drop_empty(spark, sf):
    early = observations(spark, sf).filter((F.col("hours") <= 3) & F.col("raw").isNotNull())
    return grids.skipped_stays(stay_labels(spark, sf), early)


@query("hour_slot", f"""
WITH {OBS}, z AS (SELECT stay_id, row_no, CAST(trunc(hours / 24) AS INTEGER) AS h FROM obs)
SELECT stay_id, row_no, CASE WHEN h < {PERIOD} THEN h WHEN h = {PERIOD} THEN h - 1 END AS slot FROM z""")
def hour_slot(spark, sf):
    return observations(spark, sf).select(
        "stay_id", "row_no", grids.hour_slot(F.col("hours"), F.lit(PERIOD), "stop", DAY).alias("slot"))


@query("window_slots", f"""
WITH {OBS} SELECT stay_id, CAST(least(floor(t / 24 + 1 - 1e-6), {PERIOD}) AS INTEGER) AS n FROM stays""")
def window_slots(spark, sf):
    return stay_labels(spark, sf).select("stay_id", grids.window_slots(F.col("t") / 24, PERIOD).alias("n"))


GRID = f"""{CLIP},
slot AS (SELECT *, CASE WHEN CAST(trunc(hours / 24) AS INTEGER) >= {WHOLE} THEN {WHOLE - 1} ELSE CAST(trunc(hours / 24) AS INTEGER) END AS slot
         FROM clipped),
grid AS (SELECT stay_id, slot, channel, arg_max(raw, row_no) AS value FROM slot WHERE raw IS NOT NULL GROUP BY ALL),
ch AS (SELECT unnest({CHANNELS}) AS channel, unnest({list(NORMALS.values())}) AS normal),
dense AS (SELECT s.stay_id, g.generate_series AS slot, c.channel, c.normal, grid.value, CAST(grid.value IS NOT NULL AS INTEGER) AS mask
          FROM stays s CROSS JOIN generate_series(0, {WHOLE - 1}) g CROSS JOIN ch c
          LEFT JOIN grid ON grid.stay_id = s.stay_id AND grid.slot = g.generate_series AND grid.channel = c.channel)"""


def _grid(spark, sf):
    return grids.grid_last(_clipped(spark, sf), WHOLE, DAY)


def _dense(spark, sf):
    return grids.dense_grid(_grid(spark, sf), stay_labels(spark, sf), CHANNELS, F.lit(WHOLE))


@query("grid_last", f"WITH {GRID} SELECT stay_id, slot, channel, value FROM grid")
def grid_last(spark, sf):
    return _grid(spark, sf)


@query("dense_grid", f"WITH {GRID} SELECT stay_id, CAST(slot AS INTEGER) AS slot, channel, value, mask FROM dense")
def dense_grid(spark, sf):
    return _dense(spark, sf)


@query("los_samples", f"""WITH {OBS},
lab AS (SELECT stay_id, t * f AS t FROM stays CROSS JOIN (VALUES (0.05), (0.1)) v(f)),
lim AS (SELECT o.*, l.t, CAST(least(floor(l.t + 1 - 1e-6), 72) AS INTEGER) AS n FROM obs o JOIN lab l USING (stay_id)),
late AS (SELECT stay_id, t, min(row_no) AS late FROM lim WHERE hours > t + 1e-6 GROUP BY ALL),
cl AS (SELECT lim.*, CAST(trunc(hours) AS INTEGER) AS h FROM lim LEFT JOIN late USING (stay_id, t) WHERE late IS NULL OR row_no < late),
pl AS (SELECT *, CASE WHEN h = n THEN h - 1 ELSE h END AS slot, max(h - n) OVER (PARTITION BY stay_id, t ORDER BY row_no) AS over_by FROM cl)
SELECT stay_id, round(t, 6) AS t, any_value(n) AS lens, count(DISTINCT slot || channel) FILTER (raw IS NOT NULL AND over_by <= 0) AS n_observed,
       any_value(CASE WHEN t < 72 THEN 0 WHEN t < 168 THEN 1 WHEN t < 336 THEN 2 ELSE 3 END) AS label FROM pl GROUP BY stay_id, t""")
def los_samples(spark, sf):
    both = F.explode(F.array(F.lit(0.05), F.lit(0.1))).alias("f")
    labels = stay_labels(spark, sf).select("stay_id", "t", both).select("stay_id", (F.col("t") * F.col("f")).alias("t"))
    labels = labels.withColumn("y", F.col("t")).withColumn("sample_id", F.concat_ws("@", "stay_id", F.round("t", 6)))
    obs = observations(spark, sf).withColumn("raw", F.col("raw").cast("string"))
    s = prepare.episode_samples(obs, labels, "los", 72, channels=CHANNELS, normals=NORMALS, codes={})
    seen = F.aggregate(F.flatten("mask"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return s.select("stay_id", F.element_at(F.split("sample_id", "@"), 2).cast("double").alias("t"), "lens", seen.alias("n_observed"), "label")


MEAN = f"""{OBS},
lim AS (SELECT o.*, CAST(least(floor(s.t / 24 + 1 - 1e-6), {PERIOD}) AS INTEGER) AS n FROM obs o JOIN stays s USING (stay_id)),
sl AS (SELECT *, CAST(trunc(hours / 24) AS INTEGER) AS h FROM lim),
pl AS (SELECT *, CASE WHEN h = n THEN h - 1 ELSE h END AS slot, max(h - n) OVER (PARTITION BY stay_id ORDER BY row_no) AS over_by FROM sl),
agg AS (SELECT stay_id, slot, channel, sum(raw) AS total, count(raw) AS n_seen, arg_min(raw IS NULL, row_no) AS first_empty
        FROM pl WHERE over_by <= 0 GROUP BY stay_id, slot, channel),
ch AS (SELECT unnest({CHANNELS}) AS channel, unnest({list(NORMALS.values())}) AS normal)"""


def _mean(spark, sf, normals=None):
    crowded = crowded_stays(spark, sf)
    t = stay_labels(spark, sf).select("stay_id", grids.window_slots(F.col("t") / 24, PERIOD).alias("n_slots"))
    rows = grids.join_labels(observations(spark, sf, crowded), t, crowded)
    g = grids.grid_mean(rows, F.col("n_slots"), normals, DAY, crowded)
    return g.select("stay_id", "slot", "channel", r6("value"))


@query("grid_mean", f"WITH {MEAN} SELECT stay_id, slot, channel, round(total / n_seen, 6) AS value FROM agg WHERE n_seen > 0")
def grid_mean(spark, sf):
    return _mean(spark, sf)


@query("grid_mean_compat", f"""WITH {MEAN}
SELECT stay_id, slot, channel, round((total + CASE WHEN first_empty THEN normal ELSE 0 END) / n_seen, 6) AS value
FROM agg JOIN ch USING (channel) WHERE n_seen > 0""")
def grid_mean_compat(spark, sf):
    return _mean(spark, sf, NORMALS)


@query("impute_grid", f"""WITH {GRID}
SELECT stay_id, CAST(slot AS INTEGER) AS slot, channel, mask,
       coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY stay_id, channel ORDER BY slot), normal) AS value FROM dense""")
def impute_grid(spark, sf):
    return grids.impute_grid(_dense(spark, sf), NORMALS).select("stay_id", "slot", "channel", "mask", "value")


ZSCORE = f"""{GRID},
st AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM dense WHERE mask = 1 GROUP BY channel),
z AS (SELECT stay_id, CAST(slot AS INTEGER) AS slot, channel, mask, CASE WHEN mask = 1 THEN (value - m) / sd ELSE 0.0 END AS value
      FROM dense JOIN st USING (channel))"""


@query("zscore_grid", f"WITH {ZSCORE} SELECT stay_id, slot, channel, mask, round(value, 6) AS value FROM z")
def zscore_grid(spark, sf):
    z = grids.zscore_grid(_dense(spark, sf), CHANNELS, observed=_grid(spark, sf))
    return z.select("stay_id", "slot", "channel", "mask", r6("value"))


def _samples(spark, sf):
    dense = grids.standardized(_grid(spark, sf), stay_labels(spark, sf), CHANNELS, F.lit(WHOLE))
    return grids.pack_samples(dense, CHANNELS)


@query("pack_samples", f"""WITH {ZSCORE}, x AS (
  SELECT stay_id, slot, list(value ORDER BY channel) AS x, list(mask ORDER BY channel) AS m FROM z GROUP BY stay_id, slot)
SELECT stay_id, slot, {WHOLE} AS lens, round(x[1], 6) AS x1, round(x[5], 6) AS x5,
       concat_ws('', m[1], m[2], m[3], m[4], m[5]) AS mask FROM x""")
def pack_samples(spark, sf):
    s = _samples(spark, sf)
    rows = s.select("stay_id", "lens", F.posexplode(F.arrays_zip("x", "mask")).alias("slot", "r"))
    return rows.select("stay_id", "slot", "lens", r6(F.col("r.x")[0], "x1"), r6(F.col("r.x")[4], "x5"),
                       F.array_join("r.mask", "").alias("mask"))


@query("presence_mask", """
SELECT vec_id, pos - 1 AS step, concat_ws('', CAST(embedding[pos * 4 - 3] > 0 AS INTEGER), CAST(embedding[pos * 4 - 2] > 0 AS INTEGER),
       CAST(embedding[pos * 4 - 1] > 0 AS INTEGER), CAST(embedding[pos * 4] > 0 AS INTEGER)) AS mask,
       CAST(greatest(embedding[pos * 4 - 3], embedding[pos * 4 - 2], embedding[pos * 4 - 1], embedding[pos * 4]) > 0 AS INTEGER) AS any_seen,
       CAST(embedding[pos * 4 - 3] > 0 AS INTEGER) AS first_seen
FROM embeddings CROSS JOIN (SELECT unnest(range(1, 17)) AS pos)""")
def presence_mask(spark, sf):
    v = _visits(spark, sf)
    mask = arrays.presence_mask(F.transform("x", lambda r: F.transform(r, lambda c: F.when(c > 0, c))))
    m = v.select("vec_id", mask.alias("m"))
    rows = m.select("vec_id", F.posexplode(F.arrays_zip(
        F.col("m"), arrays.time_mask(F.col("m"), "max").alias("a"), arrays.time_mask(F.col("m"), "first").alias("f"))).alias("step", "r"))
    return rows.select("vec_id", F.col("step").cast("bigint").alias("step"), F.array_join("r.m", "").alias("mask"),
                       F.col("r.a").alias("any_seen"), F.col("r.f").alias("first_seen"))


def _visits(spark, sf):
    """Vectors cut into 16 steps of 4 features; the label sets how many steps are real."""
    e = table(spark, sf, "embeddings")
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(
        F.col("embedding").cast("array<double>"), i * 4 + 1, F.lit(4)))
    return e.select("vec_id", "label", x.alias("x"), (F.col("label") + 3).alias("lens"))


@query("assert_width", "SELECT vec_id, CAST(len(embedding) AS INTEGER) // 4 AS steps FROM embeddings")
def assert_width(spark, sf):
    v = _visits(spark, sf)
    return v.select("vec_id", F.size(arrays.checked_width(F.col("x"), 4, F.col("vec_id"))).alias("steps"))


@query("pad_samples", """
WITH v AS (SELECT vec_id, label // 5 AS batch, label + 3 AS lens, embedding FROM embeddings),
     m AS (SELECT batch, max(lens) AS n FROM v GROUP BY batch)
SELECT v.vec_id, v.lens, m.n AS padded_lens, g.step - 1 AS step, CAST(g.step <= v.lens AS INTEGER) AS valid,
       CASE WHEN g.step <= v.lens THEN CAST(embedding[g.step * 4] AS DOUBLE) ELSE 0.0 END AS x4
FROM v JOIN m USING (batch) JOIN (SELECT unnest(range(1, 17)) AS step) g ON g.step <= m.n""")
def pad_samples(spark, sf):
    v = _visits(spark, sf).withColumn("batch", F.floor(F.col("label") / 5))
    short = v.withColumn("x", F.slice("x", F.lit(1), F.col("lens")))
    p = grids.pad_samples(short.withColumn("mask", arrays.presence_mask(F.col("x"))), "batch", 4)
    rows = p.select("vec_id", "lens", "padded_lens", F.posexplode(F.arrays_zip("x", "valid")).alias("step", "r"))
    return rows.select("vec_id", "lens", "padded_lens", F.col("step").cast("bigint").alias("step"),
                       F.col("r.valid").alias("valid"), F.col("r.x")[3].alias("x4"))


@query("last_visit", """
SELECT vec_id, CAST(embedding[(label + 3) * 4] AS DOUBLE) AS x4, CAST(embedding[4] AS DOUBLE) AS empty_x4 FROM embeddings""")
def last_visit(spark, sf):
    v = _visits(spark, sf)
    return v.select("vec_id", arrays.last_step(F.col("x"), F.col("lens"))[3].alias("x4"),
                    arrays.last_step(F.col("x"), F.lit(0))[3].alias("empty_x4"))


@query("time_mask", """
SELECT vec_id, CAST(list_sum(list_transform(range(1, 17), lambda p: CAST(embedding[p * 4 - 3] > 0 AS INTEGER))) AS INTEGER) AS n_first,
       CAST(list_sum(list_transform(range(1, 17), lambda p: CAST(greatest(embedding[p * 4 - 3], embedding[p * 4 - 2],
            embedding[p * 4 - 1], embedding[p * 4]) > 0 AS INTEGER))) AS INTEGER) AS n_any
FROM embeddings""")
def time_mask(spark, sf):
    m = F.transform("x", lambda r: F.transform(r, lambda c: (c > 0).cast("int")))
    return _visits(spark, sf).select(
        "vec_id", arrays.mask_length(arrays.time_mask(m, "first")).alias("n_first"),
        arrays.mask_length(arrays.time_mask(m, "max")).alias("n_any"))


@query("split_static", """
SELECT vec_id, p - 1 AS step, CAST(embedding[1] AS DOUBLE) AS s1, CAST(embedding[2] AS DOUBLE) AS s2,
       CAST(embedding[p * 4 - 1] AS DOUBLE) AS d1, CAST(embedding[p * 4] AS DOUBLE) AS d2,
       CAST(embedding[2] AS DOUBLE) AS last_joined
FROM embeddings CROSS JOIN (SELECT unnest(range(1, 17)) AS p)""")
def split_static(spark, sf):
    v = grids.split_static(_visits(spark, sf).select("vec_id", "x"), "vec_id", 2, 4)
    j = grids.attach_static(v.withColumn("dyn", F.col("x")))
    rows = j.select("vec_id", "static", F.posexplode(F.arrays_zip("dyn", F.col("x").alias("j"))).alias("step", "r"))
    return rows.select("vec_id", F.col("step").cast("bigint").alias("step"), F.col("static")[0].alias("s1"),
                       F.col("static")[1].alias("s2"), F.col("r.dyn")[0].alias("d1"), F.col("r.dyn")[1].alias("d2"),
                       F.col("r.j")[3].alias("last_joined"))


_U_ROW = sql_uniform("vec_id", str(SEED))
_U_CELL = sql_uniform("vec_id", "p - 1", "q - 1", str(SEED))


@query("mask_cells", f"""
WITH c AS (SELECT vec_id, label, p, q, CAST(embedding[(p - 1) * 4 + q] AS DOUBLE) AS v, CAST(embedding[(p - 1) * 4 + q] > 0 AS INTEGER) AS m
           FROM embeddings CROSS JOIN (SELECT unnest(range(1, 17)) AS p) CROSS JOIN (SELECT unnest(range(1, 5)) AS q)),
     h AS (SELECT *, label < 8 AND {_U_CELL} < {_U_ROW} * 0.4 + 0.2 AS hide FROM c)
SELECT vec_id, round(sum(CASE WHEN hide THEN 0 ELSE v END), 6) AS x_sum, CAST(sum(CASE WHEN hide THEN 0 ELSE m END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN hide THEN m ELSE 0 END) AS BIGINT) AS hidden,
       CAST(sum(CASE WHEN label < 8 AND m = 1 AND {_U_CELL} < 0.1 THEN 0 ELSE m END) AS BIGINT) AS kept_fixed_rate
FROM h GROUP BY vec_id""")
def mask_cells(spark, sf):
    v = _visits(spark, sf)
    v = v.withColumn("mask", F.transform("x", lambda r: F.transform(r, lambda c: (c > 0).cast("int"))))
    train = F.col("label") < 8

    def cells(c):
        return F.aggregate(F.flatten(c), F.lit(0.0), lambda s, z: s + z.cast("double"))

    a = grids.mask_cells(v, "vec_id", 0.2, 0.6, SEED, train).withColumn("x_sum", cells(F.col("x")))
    b = grids.drop_cells(a, "vec_id", 0.1, SEED, train)
    return b.select("vec_id", r6("x_sum"), cells(F.col("kept_mask")).cast("bigint").alias("kept"),
                    cells(F.col("hidden_mask")).cast("bigint").alias("hidden"),
                    cells(F.col("mask")).cast("bigint").alias("kept_fixed_rate"))


# ---- splits --------------------------------------------------------------------------------------------------------

def _rank_sql(id_col, source):
    return f"""SELECT {id_col}, row_number() OVER (ORDER BY {sql_hash(id_col, str(SEED))}, {id_col}) - 1 AS rank0,
               count(*) OVER () AS n_total FROM {source}"""


@query("ordered", _rank_sql("o_orderkey", "orders"))
def ordered(spark, sf):
    return splits.ordered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SEED)


@query("split_ratio", f"""
WITH r AS ({_rank_sql('c_custkey', 'customer')})
SELECT c_custkey, CASE WHEN rank0 < floor(n_total * CAST(0.8 AS DOUBLE)) THEN 'train'
  WHEN rank0 < floor(n_total * CAST(0.8 AS DOUBLE)) + floor(n_total * ((1 - CAST(0.8 AS DOUBLE)) / 2)) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_ratio(spark, sf):
    return splits.split_ratio(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.8, SEED)


@query("split_counts", f"""
WITH r AS ({_rank_sql('vec_id', 'embeddings')})
SELECT vec_id, CASE WHEN rank0 < 200 THEN 'test' WHEN rank0 < 280 THEN 'train' ELSE 'val' END AS split FROM r""")
def split_counts(spark, sf):
    return splits.split_counts(table(spark, sf, "embeddings").select("vec_id"), "vec_id", SEED)


@query("head_per_split", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderstatus FROM r WHERE rn <= CASE o_orderstatus WHEN 'F' THEN 160 WHEN 'O' THEN 20 WHEN 'P' THEN 30 END""")
def head_per_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return splits.head_per_split(o, {"F": 160, "O": 20, "P": 30}, "o_orderkey", "o_orderstatus")


@query("filter_by_tokens", """
WITH t AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT lang, count(*) AS n_before, count(*) FILTER (n <= 400) AS n_kept, count(*) FILTER (n > 400) AS n_dropped FROM t GROUP BY lang""")
def filter_by_tokens(spark, sf):
    return splits.dropped_by_tokens(table(spark, sf, "documents"), "text", 400, "lang")


@query("pick_random", f"""
WITH pool AS (SELECT label AS cohort, count(*) AS size FROM embeddings GROUP BY label),
cand AS (SELECT n_nationkey AS query_id, cohort, size, sum(size) OVER (PARTITION BY n_nationkey ORDER BY cohort) - size AS start,
                sum(size) OVER (PARTITION BY n_nationkey) AS pool_size
         FROM nation JOIN pool ON cohort IN (n_nationkey // 3, n_regionkey + 4)),
placed AS (SELECT label AS cohort, vec_id AS node, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('vec_id', str(SEED))}, vec_id) - 1 AS pos FROM embeddings),
{floyd_sql('cand', 'placed', SEED)}
SELECT query_id, rank, node FROM drawn""")
def pick_random(spark, sf):
    n = table(spark, sf, "nation")
    cands = n.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array_distinct(F.array(
        F.floor(F.col("n_nationkey") / 3).cast("int"), F.col("n_regionkey") + 4))).alias("cohort"))
    members = table(spark, sf, "embeddings").select(F.col("label").alias("cohort"), F.col("vec_id").alias("node"))
    return splits.pick_random(cands, members, 3, SEED)


@query("resample", f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT b.generate_series AS replicate, CAST(floor({sql_uniform('b.generate_series', 'j.generate_series', '42')} * n.n) AS BIGINT) AS rank0
      FROM n CROSS JOIN generate_series(0, 999) b CROSS JOIN generate_series(0, (SELECT count(*) - 1 FROM embeddings)) j),
r AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_hash('vec_id', '42')}, vec_id) - 1 AS rank0 FROM embeddings)
SELECT replicate, vec_id, count(*) AS weight FROM d JOIN r USING (rank0) GROUP BY replicate, vec_id""")
def resample(spark, sf):
    return splits.resample(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 1000, 42)
