"""From raw observations or visit records to labelled model samples with splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import checked_width, presence_mask
from ..functions.scalars import bucketize_los, encode_category
from ..operators import grids
from ..operators.joins import crowded_keys, join_per_key
from ..operators.splits import split_counts, split_ratio
from ..session import written
from . import catalogue


def coded(obs: DataFrame, codes: dict[str, dict] | None = None) -> DataFrame:
    """Raw cell texts to numbers: category labels by their codes (unknown labels fail), the rest by cast."""
    codes = catalogue.CATEGORY_CODES if codes is None else codes
    flat = {f"{ch}|{label}": code for ch, m in codes.items() for label, code in m.items()}
    key = F.when(F.col("raw").isNotNull(), F.concat(F.col("channel"), F.lit("|"), F.col("raw")))
    is_category = F.col("channel").isin(list(codes))
    value = F.when(is_category, encode_category(key, flat)).otherwise(F.col("raw").cast("double"))
    return obs.withColumn("raw", value)


def per_sample(obs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and labels keyed by sample: every label row is a sample with the rows of its stay.

    ``labels`` may bring a ``sample_id``; without one, samples are named by stay and time, so equal lines are one. Both
    results have the sample in ``stay_id``, the key of all grid operators, and the stay in ``of_stay``. A stay's rows are
    repeated for each of its samples, as each sample has a grid of its own; crowded stays are salted.
    """
    if "sample_id" not in labels.columns:
        labels = labels.withColumn("sample_id", F.concat_ws("@", F.col("stay_id").cast("string"), F.col("t").cast("string"))).dropDuplicates(["sample_id"])
    keys = labels.select("stay_id", "sample_id")
    rows = join_per_key(obs, keys, "stay_id").withColumn("of_stay", F.col("stay_id")).withColumn("stay_id", F.col("sample_id")).drop("sample_id")
    return rows, labels.withColumn("of_stay", F.col("stay_id")).withColumn("stay_id", F.col("sample_id")).drop("sample_id")


def episode_samples(obs: DataFrame, labels: DataFrame, task: str, period: int, fit_on: Column | None = None,
                    compat: bool = False, channels: list[str] | None = None, normals: dict | None = None,
                    codes: dict | None = None) -> DataFrame:
    """``(stay_id, sample_id, x, mask, lens, label)`` for task ``mortality`` or ``los``.

    mortality: one sample a stay, rows up to ``period`` hours, last value per hour. los: one sample for each label row,
    rows up to its own time ``t``, mean per hour, label in four classes. Samples without rows are dropped. ``fit_on`` is a
    condition on the sample's ``stay_id``.
    """
    channels = channels or catalogue.CHANNELS
    normals = catalogue.normal_codes() if normals is None else normals
    if task == "mortality":
        labels = labels.withColumn("t", F.lit(float(period))).withColumn("label", F.col("y")).withColumn("of_stay", F.col("stay_id"))
        slots = labels.select("stay_id", F.lit(period).alias("n_slots"))
    elif task == "los":
        obs, labels = per_sample(obs, labels)
        obs = written(obs.drop("of_stay"), "sample_rows")
        labels = labels.withColumn("label", bucketize_los(F.col("y")))
        slots = labels.select("stay_id", grids.window_slots(F.col("t"), period).alias("n_slots"))
    else:
        raise ValueError("task must be 'mortality' or 'los'")
    crowded = crowded_keys(obs, "stay_id")
    rows = coded(grids.clip_to_bound(obs, labels, crowded), codes)
    labels = grids.drop_empty(labels, rows)
    stays = slots.join(labels.select("stay_id"), "stay_id", "left_semi")
    if task == "mortality":
        grid = grids.grid_last(rows, period)
    else:
        windowed = join_per_key(rows, slots, "stay_id", crowded=crowded)
        grid = grids.grid_mean(windowed, F.col("n_slots"), normals if compat else None, crowded=crowded)
    packed = grids.pack_samples(grids.standardized(grid, stays, channels, F.col("n_slots"), fit_on), channels)
    found = packed.join(labels.select("stay_id", "of_stay", "label"), "stay_id")
    return found.select(F.col("of_stay").alias("stay_id"), F.col("stay_id").alias("sample_id"), *[c for c in packed.columns if c != "stay_id"], "label")


def visit_samples(visits: DataFrame, width: int) -> DataFrame:
    """``(name, x, mask, lens, label)`` from visit records; a wrong width is an error that names the row."""
    x = checked_width(F.col("x_ts"), width, F.col("name"))
    return visits.select("name", x.alias("x"), presence_mask(F.col("x_ts")).alias("mask"),
                         F.size("x_ts").alias("lens"), F.col("y").alias("label"))


def with_split(df: DataFrame, id_col: str, seed: int, ratio: float | None = 0.8, counts: dict | None = None) -> DataFrame:
    """Ratio split, or fixed counts ``{"test": 200, "train": 80}``."""
    return split_counts(df, id_col, seed, **counts) if counts else split_ratio(df, id_col, ratio, seed)


