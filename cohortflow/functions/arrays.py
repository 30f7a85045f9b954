"""Functions on time x channel matrices stored as nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v.cast("double"))


def presence_mask(x: Column) -> Column:
    """1 where a cell holds a value, 0 where it is null or NaN."""
    return F.transform(x, lambda row: F.transform(row, lambda v: F.when(_present(v), 1).otherwise(0)))


def checked_width(x: Column, width: int, row_id: Column) -> Column:
    """``x`` unchanged when every row has ``width`` cells, else an error naming the row."""
    message = F.concat(F.lit(f"expected {width} columns in row "), row_id.cast("string"))
    return F.when(F.exists(x, lambda row: F.size(row) != width), F.raise_error(message)).otherwise(x)


def last_step(values: Column, lens: Column) -> Column:
    """The last valid entry of a sequence; an empty mask falls back to the first entry."""
    return F.try_element_at(values, F.greatest(lens, F.lit(1)))


def mask_length(mask: Column) -> Column:
    """Number of present steps of a 0/1 step mask (gaps shorten it)."""
    return F.aggregate(mask, F.lit(0), lambda a, v: a + v.cast("int"))


def time_mask(mask: Column, how: str = "first") -> Column:
    """Reduce a time x channel mask to one flag per step: first channel, or any channel."""
    if how == "first":
        return F.transform(mask, lambda row: F.element_at(row, 1))
    if how == "max":
        return F.transform(mask, F.array_max)
    raise ValueError("how must be 'first' or 'max'")


def static_part(x: Column, d: int) -> Column:
    """The first ``d`` features of the first step."""
    return F.slice(F.element_at(x, 1), 1, d)


def dynamic_part(x: Column, d: int) -> Column:
    """Every step without its first ``d`` features."""
    return F.transform(x, lambda row: F.slice(row, F.lit(d + 1), F.greatest(F.size(row) - d, F.lit(0))))


def with_static(x: Column, static: Column) -> Column:
    """Append the static features to every step."""
    return F.transform(x, lambda row: F.concat(row, static))


def padded(x: Column, length: Column, width: int, fill: float = 0.0) -> Column:
    """Append filler steps until ``length`` steps exist."""
    blank = F.array_repeat(F.lit(fill), width)
    return F.concat(x, F.array_repeat(blank, F.greatest(length - F.size(x), F.lit(0))))


def valid_steps(lens: Column, length: Column) -> Column:
    """1 for positions before ``lens``, 0 after, up to ``length``."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: (i < lens).cast("int"))
