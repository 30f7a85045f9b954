"""Readers of raw episodes, label lists, visit records, questions and channel settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def read_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV per stay, first column ``Hours``, to ``(stay_id, row_no, hours, channel, raw)``.

    ``row_no`` is the byte offset of the file part plus the line in it: it grows with the line order, also
    when a long file is read by several tasks, and no stay is numbered in one task.
    """
    df = spark.read.option("header", True).option("enforceSchema", False).csv(f"{folder.rstrip('/')}/*.csv")
    if df.columns[0] != "Hours":
        raise ValueError(f"first column must be Hours, found {df.columns[0]}")
    channels = df.columns[1:]
    lines = df.select("*", F.col("_metadata.file_name").alias("stay_id"),
                      F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    part = Window.partitionBy("stay_id", "_start").orderBy("_id")
    rows = lines.withColumn("row_no", F.col("_start") + F.row_number().over(part) - 1)
    wide = rows.select("stay_id", "row_no", F.col("Hours").cast("double").alias("hours"), *[f"`{c}`" for c in channels])
    return wide.unpivot(["stay_id", "row_no", "hours"], [F.col(f"`{c}`") for c in channels], "channel", "raw")


def read_listfile(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Label list of a task: mortality, decompensation, los, phenotyping or multitask."""
    layouts = {
        "mortality": "stay_id string, y int",
        "decompensation": "stay_id string, t double, y int",
        "los": "stay_id string, t double, y double",
        "phenotyping": "stay_id string, t double, " + ", ".join(f"y{i} int" for i in range(1, 26)),
        "multitask": "stay_id string, t double, ihm string, los string, pheno string, decomp string",
    }
    df = spark.read.option("header", True).schema(layouts[task]).csv(path)
    if task == "phenotyping":
        return df.select("stay_id", "t", F.array(*[f"y{i}" for i in range(1, 26)]).alias("y"))
    if task != "multitask":
        return df

    def parts(c):
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ";"))

    def half(c, which, kind):
        p = parts(c)
        n = F.floor(F.size(p) / 2).cast("int")
        piece = F.slice(p, F.lit(1), n) if which == 0 else F.slice(p, n + 1, F.size(p) - n)
        return piece.cast(f"array<{kind}>")

    return df.select(
        "stay_id", "t", parts("ihm").cast("array<int>").alias("ihm"),
        F.struct(half("los", 0, "int").alias("mask"), half("los", 1, "double").alias("y")).alias("los"),
        parts("pheno").cast("array<int>").alias("pheno"),
        F.struct(half("decomp", 0, "int").alias("mask"), half("decomp", 1, "int").alias("y")).alias("decomp"))


def pool(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All listings one under the other, columns matched by name."""
    for df in more:
        first = first.unionByName(df)
    return first


VISIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("x_llm_ts", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("x_ts", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("record_time", T.ArrayType(T.DoubleType())),
    T.StructField("missing_mask", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def visits(df: DataFrame, task: str, width: int | None = 19) -> DataFrame:
    """Visit records to ``(name, x, x_ts, t, y, missing_mask)``.

    Rows whose readable matrix has another width are dropped (no check with ``None``), recorded times are cut
    to the number of rows, and a label list counts by its first entry.
    """
    x, y = F.col("x_llm_ts"), F.col(f"y_{task}")
    if df.schema[f"y_{task}"].dataType.typeName() == "array":
        y = F.element_at(y, 1)
    if width is not None:
        df = df.filter((F.size(x) > 0) & F.forall(x, lambda row: F.size(row) == width))
    known = F.col("record_time") if "record_time" in df.columns else F.lit(None).cast("array<double>")
    times = F.coalesce(known, F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: i.cast("double")))
    return df.select(F.col("id").alias("name"), x.alias("x"), "x_ts",
                     F.size(F.slice(times, F.lit(1), F.size(x))).alias("t"), y.cast("int").alias("y"), "missing_mask")


def read_visits(spark: SparkSession, path: str, task: str, width: int | None = 19) -> DataFrame:
    """:func:`visits` over parquet."""
    return visits(spark.read.parquet(path), task, width)


def channel_header(names: Column, n: int) -> Column:
    """``Sex, Age`` and n lab names; missing names or another count give ``labtest_features[i]``."""
    plain = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(
        F.lit("labtest_features["), i.cast("string"), F.lit("]")))
    return F.concat(F.array(F.lit("Sex"), F.lit("Age")), F.when(F.size(names) == n, names).otherwise(plain))


def _json_type(value) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, dict):
        return T.MapType(T.StringType(), T.StringType())
    if isinstance(value, list):
        return T.ArrayType(T.StringType())
    return T.StringType()


def read_questions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines whose keys are fixed by the first record: absent keys are null, other keys are ignored."""
    if schema is None:
        head = json.loads(spark.read.text(path).first()[0])
        schema = T.StructType([T.StructField(k, _json_type(v)) for k, v in head.items()])
    return spark.read.schema(schema).json(path)


def read_channels(spark: SparkSession, config: str, codes: str) -> tuple[DataFrame, DataFrame]:
    """Two JSON files to ``channels(idx, name, is_categorical, normal_value)`` and ``codes(channel, label, code)``."""
    c = spark.read.schema(
        "id_to_channel array<string>, is_categorical_channel map<string,boolean>, normal_values map<string,string>"
    ).option("multiLine", True).json(config)
    channels = c.select("*", F.posexplode("id_to_channel").alias("idx", "name")).select(
        "idx", "name", F.element_at("is_categorical_channel", F.col("name")).alias("is_categorical"),
        F.element_at("normal_values", F.col("name")).alias("normal_value"))
    entry = "struct<possible_values:array<string>, values:map<string,int>>"
    text = spark.read.text(codes, wholetext=True)
    maps = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("channel", "e"))
    return channels, maps.select("channel", F.explode("e.values").alias("label", "code")).withColumn(
        "code", F.col("code").cast("double"))
