"""Column expressions of data skipping: overlap, containment, cells, index arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Bounds = tuple[float, float]
EVERYTHING: Bounds = (-math.inf, math.inf)
#: Fixed value: how much wider than the extent of its values a block is cut.
INFLATE = 1.1


def overlaps(low: Column, high: Column, bounds: Bounds) -> Column:
    """Closed intervals meet: touching bounds count, infinite bounds are no condition."""
    out = F.lit(True)
    if bounds[1] != math.inf:
        out = out & (low <= bounds[1])
    if bounds[0] != -math.inf:
        out = out & (high >= bounds[0])
    return out


def meets_box(box: dict[str, Bounds]) -> Column:
    """Envelope columns min<axis>, max<axis> meet the box on every axis that it names."""
    out = F.lit(True)
    for axis, bounds in box.items():
        out = out & overlaps(F.col(f"min{axis}"), F.col(f"max{axis}"), bounds)
    return out


def within(column: Column, bounds: Bounds) -> Column:
    """The value lies in the closed interval; NaN lies in none."""
    return overlaps(column, column, bounds) & ~F.isnan(column)


def lowest(column: Column) -> Column:
    """min() that ignores NaN."""
    return F.min(F.nanvl(column, F.lit(None).cast("double")))


def highest(column: Column) -> Column:
    return F.max(F.nanvl(column, F.lit(None).cast("double")))


def cell(value: Column, low: Column, high: Column, n: int, inflate: float = INFLATE) -> Column:
    """The value's cell among n along [low, high], whose width is inflated so that the maximum falls inside; 0 where flat."""
    return F.when(high > low, F.floor((value - low) / ((high - low) * inflate / n))).otherwise(0).cast("long")


def cut_block(low: Column, high: Column, n: int, inflate: float = INFLATE) -> Column:
    """The n parts of an interval, as an array of (low, high)."""
    step = (high - low) * inflate / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((low + k * step).alias("low"), (low + (k + 1) * step).alias("high")))


def row_major(indices: list[Column], shape: list[int]) -> Column:
    """Offset of N-D indices, the last running fastest."""
    out = F.lit(0).cast("long")
    for index, n in zip(indices, shape):
        out = out * n + index
    return out


def from_row_major(offset: Column, shape: list[int]) -> list[Column]:
    out, stride = [], math.prod(shape)
    for n in shape:
        stride //= n
        out.append(F.pmod(F.floor(offset / stride), F.lit(n)).cast("long"))
    return out
