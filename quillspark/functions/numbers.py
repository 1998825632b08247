"""Chart geometry, shares and rectangles as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenth(x: Column) -> Column:
    """To one decimal, halves to even."""
    return F.bround(x, 1)


def percent(part: Column, total: Column) -> Column:
    """Share in percent; a total of 0 counts as 1."""
    return F.lit(100.0) * part / F.when(F.coalesce(total, F.lit(0)) == 0, 1).otherwise(total)


def scale_x(i: Column, n: Column, left: float, right: float) -> Column:
    return F.lit(left) + i * (F.lit(right - left) / (n - 1))


def scale_y(value: Column, peak: Column, height: float) -> Column:
    """Four units of room above and below; the peak lies at 4."""
    return F.lit(4.0) + F.lit(height - 8) * (F.lit(1.0) - value / peak)


def bar_width(n: Column, width: float) -> Column:
    return F.greatest(F.lit(3.0), F.least(F.lit(16.0), F.lit(width) / n - 3.0))


def bar_height(value: Column, peak: Column, height: float) -> Column:
    return F.greatest(F.lit(height) * value / peak, F.lit(0.5))


Rect = tuple[Column, Column, Column, Column]


def intersects(a: Rect, b: Rect) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def clip(a: Rect, b: Rect) -> Rect:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def union(a: Rect, b: Rect) -> Rect:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def union_all(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes (x0, y0, x1, y1) of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
