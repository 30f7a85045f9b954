"""Registry and shared inputs of the query suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortflow.operators.joins import crowded_keys, join_per_key

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEED = 3407


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


CHANNELS = ["click", "error", "purchase", "signup", "view"]
NORMALS = {"click": 20.0, "error": 30.0, "purchase": 40.0, "signup": 50.0, "view": 60.0}
DAY = 24.0


def crowded_stays(spark, sf):
    return crowded_keys(table(spark, sf, "events"), "user_id")


def observations(spark, sf, crowded=None) -> DataFrame:
    """Users are stays, event types are channels, small values are missing cells."""
    e = table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return join_per_key(e, first, "user_id", crowded=crowded).select(
        F.col("user_id").alias("stay_id"), F.col("event_id").alias("row_no"),
        (F.expr("timestampdiff(MICROSECOND, t0, ts)") / F.lit(3.6e9)).alias("hours"),
        F.col("event_type").alias("channel"), F.when(F.col("value") >= 8, F.col("value")).alias("raw"))


def stay_labels(spark, sf) -> DataFrame:
    """One label row per stay: bound t in hours and a 0/1 outcome."""
    raw = F.when(F.col("value") >= 8, F.col("value"))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("stay_id")).agg(
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / F.lit(3.6e9) * 0.75).alias("t"),
        (F.max(raw) > 300).cast("int").alias("y"))


OBS = """
obs AS (SELECT e.user_id AS stay_id, e.event_id AS row_no, (epoch_us(e.ts) - f.t0) / 3.6e9 AS hours,
               e.event_type AS channel, CASE WHEN e.value >= 8 THEN e.value END AS raw
        FROM events e JOIN (SELECT user_id, min(epoch_us(ts)) AS t0 FROM events GROUP BY user_id) f
          ON e.user_id = f.user_id),
stays AS (SELECT stay_id, max(hours) * 0.75 AS t, CAST(max(raw) > 300 AS INTEGER) AS y FROM obs GROUP BY stay_id)"""


def sql_hash(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_uniform(*parts: str) -> str:
    return f"(CAST('0x' || substr({sql_hash(*parts)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


def predictions(spark, sf) -> DataFrame:
    """Line items as predictions: a continuous score, a coarse one, a 0/1 label."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_linestatus", "l_returnflag", "l_linenumber", (F.col("l_extendedprice") / 110000.0).alias("score"),
        ((F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)) / 18.0).alias("coarse"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"))


PRED = """
pred AS (SELECT l_linestatus, l_returnflag, l_linenumber, l_extendedprice / 110000.0 AS score,
                (round(l_discount * 100) + round(l_tax * 100)) / 18.0 AS coarse,
                CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""


def curve_sql(source: str, score: str, label: str, by: str = "") -> str:
    """CTEs cnt and curve: cumulative counts per distinct score."""
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    group = f"{by}, " if by else ""
    return f"""
cnt AS (SELECT {head}{score} AS s, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {source} GROUP BY {group}{score}),
curve0 AS (SELECT {head}s, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
                 CAST(sum(pos) OVER ({part} ORDER BY s DESC) AS DOUBLE) AS tp,
                 CAST(sum(neg) OVER ({part} ORDER BY s DESC) AS DOUBLE) AS fp,
                 CAST(sum(pos) OVER ({part}) AS DOUBLE) AS np, CAST(sum(neg) OVER ({part}) AS DOUBLE) AS nn FROM cnt),
curve AS (SELECT *, tp / (tp + fp) AS p, tp / np AS r FROM curve0)"""


def floyd_sql(cand: str, placed: str, seed: int) -> str:
    """Three distinct positions per query by Floyd's sampling over CTEs cand(query_id, cohort, size, start, pool_size)."""
    return f"""
fq AS (SELECT DISTINCT query_id, CAST(pool_size AS BIGINT) AS n FROM {cand}),
d1 AS (SELECT query_id, n, CAST(floor({sql_uniform('query_id', '0', str(seed))} * (n - 2)) AS BIGINT) AS p1 FROM fq),
d2 AS (SELECT *, CAST(floor({sql_uniform('query_id', '1', str(seed))} * (n - 1)) AS BIGINT) AS t2 FROM d1),
e2 AS (SELECT *, CASE WHEN t2 = p1 THEN n - 2 ELSE t2 END AS p2 FROM d2),
d3 AS (SELECT *, CAST(floor({sql_uniform('query_id', '2', str(seed))} * n) AS BIGINT) AS t3 FROM e2),
e3 AS (SELECT *, CASE WHEN t3 IN (p1, p2) THEN n - 1 ELSE t3 END AS p3 FROM d3),
targets AS (SELECT query_id, 1 AS rank, p1 AS target FROM e3 UNION ALL SELECT query_id, 2, p2 FROM e3 UNION ALL SELECT query_id, 3, p3 FROM e3),
drawn AS (SELECT t.query_id, t.rank, m.node FROM targets t JOIN {cand} c ON c.query_id = t.query_id AND t.target >= c.start AND t.target < c.start + c.size
          JOIN {placed} m ON m.cohort = c.cohort AND m.pos = t.target - c.start)"""
