"""Ragged observations to fixed time grids.

``obs(stay_id, row_no, hours, channel, raw)`` holds one row per cell; ``row_no`` is the row order of a stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import checked_width, dynamic_part, padded, static_part, valid_steps, with_static
from ..functions.hashing import hash_uniform
from ..functions.scalars import let, literal_map
from .joins import crowded_keys, join_per_key

EDGE = 1e-6


def join_labels(obs: DataFrame, labels: DataFrame, crowded=None) -> DataFrame:
    """Observations with the columns of their stay's label row.

    Here and below ``crowded`` takes the stays with very many rows if they are already known
    (:func:`joins.crowded_keys`); otherwise they are counted first.
    """
    return join_per_key(obs, labels, "stay_id", crowded=crowded)


def clip_to_bound(obs: DataFrame, labels: DataFrame, crowded=None) -> DataFrame:
    """Rows of a stay before the first one later than its bound ``t`` (in row order).

    The first late row is an aggregate with map-side partials, so a stay with very many rows is neither
    sorted nor joined in one task.
    """
    if crowded is None:
        crowded = crowded_keys(obs, "stay_id")
    bounds = labels.select("stay_id", "t")
    late = (join_per_key(obs.select("stay_id", "row_no", "hours"), bounds, "stay_id", crowded=crowded)
            .filter(F.col("hours") > F.col("t") + EDGE).groupBy("stay_id").agg(F.min("row_no").alias("_late")))
    ends = bounds.select("stay_id").join(late, "stay_id", "left")
    return (join_per_key(obs, ends, "stay_id", crowded=crowded)
            .filter(F.col("_late").isNull() | (F.col("row_no") < F.col("_late"))).drop("_late"))


def drop_empty(labels: DataFrame, obs: DataFrame) -> DataFrame:
    """Label rows whose stay still has observations."""
    return labels.join(obs.select("stay_id").distinct(), "stay_id", "left_semi")


def skipped_stays(labels: DataFrame, obs: DataFrame) -> DataFrame:
    """How many label rows :func:`drop_empty` keeps and skips."""
    seen = obs.groupBy("stay_id").agg(F.lit(1).alias("_seen"))
    return labels.join(seen, "stay_id", "left").agg(
        F.count("_seen").alias("n_kept"), F.count_if(F.col("_seen").isNull()).alias("n_skipped"))


def truncated_slot(hours: Column, bucket: float = 1.0) -> Column:
    """Slot by truncation toward zero: hour -0.5 is slot 0."""
    return (hours / F.lit(float(bucket))).cast("int")


def smooth_hourly(obs: DataFrame, keep: str = "last", bucket: float = 1.0) -> DataFrame:
    """Of all rows of a stay in the same slot keep the last (or first) row, with its own time."""
    pick = {"last": F.max, "first": F.min}[keep]
    slotted = obs.withColumn("_slot", truncated_slot(F.col("hours"), bucket))
    kept = slotted.groupBy("stay_id", "_slot").agg(pick("row_no").alias("row_no"))
    return slotted.join(kept, ["stay_id", "_slot", "row_no"], "left_semi").drop("_slot")


def hour_slot(hours: Column, period: Column, on_overflow: str = "error", bucket: float = 1.0) -> Column:
    """Slot with the edge rule: slot = period is the last slot; beyond it an error, or null for ``stop``."""
    slot = truncated_slot(hours, bucket)
    if on_overflow == "error":
        beyond = F.raise_error(F.concat(F.lit("observation beyond the period: hour "), hours.cast("string")))
    elif on_overflow == "stop":
        beyond = F.lit(None).cast("int")
    else:
        raise ValueError("on_overflow must be 'error' or 'stop'")
    return F.when(slot < period, slot).when(slot == period, slot - 1).otherwise(beyond)


def window_slots(t: Column, period: int) -> Column:
    """Slots of a window that ends at hour ``t``: min(int(t + 1 - 1e-6), period)."""
    return F.least((t + F.lit(1.0) - F.lit(EDGE)).cast("int"), F.lit(period))


def slotted(obs: DataFrame, period: Column, bucket: float = 1.0, crowded=None) -> DataFrame:
    """Add ``slot``; a stay ends at its first row beyond the period, in row order."""
    placed = obs.withColumn("slot", hour_slot(F.col("hours"), period, "stop", bucket))
    ends = placed.filter(F.col("slot").isNull()).groupBy("stay_id").agg(F.min("row_no").alias("_end"))
    return (join_per_key(placed, ends, "stay_id", "left", crowded)
            .filter(F.col("_end").isNull() | (F.col("row_no") < F.col("_end"))).drop("_end"))


def grid_last(obs: DataFrame, period: int, bucket: float = 1.0) -> DataFrame:
    """Last non-empty value per (stay, slot, channel); absent cells are unobserved.

    A row beyond the period is an error. It is raised from the aggregated value: an error inside the slot
    expression could be evaluated by a pushed-down filter before the caller's own row filters.
    """
    hours, last = F.col("hours"), F.lit(period - 1)
    slot = truncated_slot(hours, bucket)
    cells = (obs.filter(F.col("raw").isNotNull())
             .withColumn("slot", F.least(slot, last)).withColumn("_late", F.when(slot > period, hours))
             .groupBy("stay_id", "slot", "channel")
             .agg(F.max_by(F.col("raw").cast("double"), F.col("row_no")).alias("_v"), F.max("_late").alias("_late")))
    message = F.concat(F.lit("observation beyond the period: hour "), F.col("_late").cast("string"))
    value = F.when(F.col("_late").isNotNull(), F.raise_error(message)).otherwise(F.col("_v"))
    return cells.select("stay_id", "slot", "channel", value.alias("value"))


def grid_mean(obs: DataFrame, period: Column, normals: dict[str, float] | None = None, bucket: float = 1.0,
              crowded=None) -> DataFrame:
    """Mean of the values per (stay, slot, channel), rows beyond the window ignored.

    With ``normals`` the compatible form: when the first row of a slot is empty for a channel, the normal
    value of that channel is added to the sum (not to the count).
    """
    value = F.col("raw").cast("double")
    cells = (slotted(obs, period, bucket, crowded).groupBy("stay_id", "slot", "channel")
             .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"),
                  F.min_by(F.struct(value.alias("v")), F.col("row_no")).alias("_first"))
             .filter(F.col("_n") > 0))
    extra = F.lit(0.0)
    if normals:
        normal = F.try_element_at(literal_map({k: float(v) for k, v in normals.items()}), F.col("channel"))
        extra = F.when(F.col("_first.v").isNull(), F.coalesce(normal, F.lit(0.0))).otherwise(F.lit(0.0))
    return cells.select("stay_id", "slot", "channel", ((F.col("_sum") + extra) / F.col("_n")).alias("value"))


def dense_grid(grid: DataFrame, stays: DataFrame, channels: list[str], slots: Column) -> DataFrame:
    """Every (stay, slot, channel) of the given stays, with ``value`` and ``mask``."""
    names = F.array(*[F.lit(c) for c in channels])
    cells = (stays.select("stay_id", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
             .select("stay_id", "slot", F.explode(names).alias("channel")))
    return (cells.join(grid, ["stay_id", "slot", "channel"], "left")
            .withColumn("mask", F.col("value").isNotNull().cast("int")))


def impute_grid(dense: DataFrame, normals: dict[str, float]) -> DataFrame:
    """Fill unobserved cells of a dense grid: previous slot's value, before any value the channel's normal.

    A (stay, channel) group has one row per slot, so the window is bounded by the period.
    """
    carry = (Window.partitionBy("stay_id", "channel").orderBy("slot")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    normal = F.try_element_at(literal_map({k: float(v) for k, v in normals.items()}), F.col("channel"))
    return dense.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(carry), normal))


def zscore_grid(dense: DataFrame, channels: list[str], fit_on: Column | None = None,
                observed: DataFrame | None = None) -> DataFrame:
    """Masked z-score per channel (population deviation over observed cells), 0 where unobserved.

    ``observed`` gives the observed cells directly (the sparse grid), so the statistics need no dense grid.
    The statistics table has one row per listed channel, which bounds the broadcast.
    """
    grid = dense.filter(F.col("channel").isin(channels))
    seen = grid.filter(F.col("mask") == 1) if observed is None else observed.filter(F.col("channel").isin(channels))
    if fit_on is not None:
        seen = seen.filter(fit_on)
    stats = seen.groupBy("channel").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    z = F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))
    return (grid.join(F.broadcast(stats), "channel", "left")
            .withColumn("value", F.when(F.col("mask") == 1, F.coalesce(z, F.lit(0.0))).otherwise(F.lit(0.0)))
            .drop("_mean", "_std"))


def standardized(grid: DataFrame, stays: DataFrame, channels: list[str], slots: Column,
                 fit_on: Column | None = None) -> DataFrame:
    """Dense z-scored grid from a sparse one: only observed cells are scored, the rest is filled with 0."""
    scored = zscore_grid(grid.withColumn("mask", F.lit(1)), channels, fit_on)
    return (dense_grid(scored.select("stay_id", "slot", "channel", "value"), stays, channels, slots)
            .withColumn("value", F.coalesce("value", F.lit(0.0))))


def pack_samples(dense: DataFrame, channels: list[str]) -> DataFrame:
    """One row per stay: ``x`` and ``mask`` as time x channel arrays, ``lens`` slots. One shuffle by stay."""
    index = literal_map({c: i for i, c in enumerate(channels)})
    width = len(channels)
    cell = F.struct("slot", F.element_at(index, F.col("channel")).alias("idx"), "value", "mask")
    packed = dense.groupBy("stay_id").agg(F.array_sort(F.collect_list(cell)).alias("_c"),
                                          (F.max("slot") + 1).alias("lens"))

    def rows(field):
        return F.transform(F.sequence(F.lit(0), F.col("lens") - 1), lambda i: F.transform(
            F.slice(F.col("_c"), i * width + 1, F.lit(width)), lambda c: c[field]))

    return packed.select("stay_id", rows("value").alias("x"), rows("mask").alias("mask"), "lens")


def pad_samples(df: DataFrame, group: str, width: int) -> DataFrame:
    """Pad ``x`` and ``mask`` to the longest sample of the group; ``valid`` flags the real steps."""
    longest = df.groupBy(group).agg(F.max("lens").alias("padded_lens"))
    out = join_per_key(df, longest, group)
    return (out.withColumn("x", padded(F.col("x"), F.col("padded_lens"), width))
            .withColumn("mask", padded(F.col("mask").cast("array<array<double>>"), F.col("padded_lens"), width)
                        .cast("array<array<int>>"))
            .withColumn("valid", valid_steps(F.col("lens"), F.col("padded_lens"))))


def split_static(df: DataFrame, id_col: str, d: int, width: int) -> DataFrame:
    """Move the first ``d`` features of the first step to ``static``; a row of another width is an error."""
    whole = df.withColumn("x", checked_width(F.col("x"), width, F.col(id_col)))
    return whole.withColumn("static", static_part(F.col("x"), d)).withColumn("x", dynamic_part(F.col("x"), d))


def attach_static(df: DataFrame) -> DataFrame:
    """Repeat ``static`` at the end of every step of ``x``."""
    return df.withColumn("x", with_static(F.col("x"), F.col("static")))


def _pairwise(a: Column, b: Column, fn) -> Column:
    """Cell by cell function of two equally shaped matrices."""
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, fn))


def mask_cells(df: DataFrame, id_col: str, lo: float, hi: float, seed: int, only: Column | None = None) -> DataFrame:
    """Random cell masking: the ratio is drawn per row in [lo, hi], a cell is hidden when its draw is below it.

    Adds ``kept_mask`` and ``hidden_mask`` and zeroes hidden cells of ``x``. ``only`` limits the rows touched.
    """
    active = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    ratio = hash_uniform(id_col, seed) * F.lit(hi - lo) + F.lit(lo)
    hide = let(ratio, lambda r: F.transform("mask", lambda row, i: F.transform(
        row, lambda m, j: active & (hash_uniform(id_col, i, j, seed) < r))))
    h = F.col("_hide")
    return (df.withColumn("_hide", hide)
            .withColumn("kept_mask", _pairwise(F.col("mask"), h, lambda m, hid: F.when(hid, 0).otherwise(m)))
            .withColumn("hidden_mask", _pairwise(F.col("mask"), h, lambda m, hid: F.when(hid, m).otherwise(0)))
            .withColumn("x", _pairwise(F.col("x"), h, lambda v, hid: F.when(hid, 0.0).otherwise(v.cast("double"))))
            .drop("_hide"))


def drop_cells(df: DataFrame, id_col: str, rate: float, seed: int, only: Column | None = None) -> DataFrame:
    """Hide present cells at a fixed rate: a hidden cell gets x = 0 and mask = 0."""
    active = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    hide = F.transform("mask", lambda row, i: F.transform(
        row, lambda m, j: active & (m == 1) & (hash_uniform(id_col, i, j, seed) < F.lit(rate))))
    h = F.col("_hide")
    return (df.withColumn("_hide", hide)
            .withColumn("x", _pairwise(F.col("x"), h, lambda v, hid: F.when(hid, 0.0).otherwise(v.cast("double"))))
            .withColumn("mask", _pairwise(F.col("mask"), h, lambda m, hid: F.when(hid, 0).otherwise(m)))
            .drop("_hide"))
