"""Measures of small pictures as column expressions: grey values or channels as arrays, row by row.

A picture is a thumbnail of fixed size, so an array is bounded; no pixels leave the engine.
"""

from __future__ import annotations

from math import cos, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def brightness(grey: Column) -> Column:
    return _mean(F.transform(grey, lambda x: x.cast("double")))


def contrast(grey: Column) -> Column:
    """The standard deviation of all grey values."""
    plain = F.transform(grey, lambda x: x.cast("double"))
    return F.get(F.transform(F.array(_mean(plain)), lambda m: F.sqrt(_mean(F.transform(plain, lambda x: (x - m) * (x - m))))), F.lit(0))


def saturation(red: Column, green: Column, blue: Column) -> Column:
    """The mean of (largest - smallest channel) / largest; black has none."""
    most = F.zip_with(F.zip_with(red, green, lambda a, b: F.greatest(a, b)), blue, lambda a, b: F.greatest(a, b).cast("double"))
    least = F.zip_with(F.zip_with(red, green, lambda a, b: F.least(a, b)), blue, lambda a, b: F.least(a, b).cast("double"))
    return _mean(F.zip_with(most, least, lambda a, b: F.when(a > 0, (a - b) / a).otherwise(0.0)))


def edge_energy(grey: Column, width: int, height: int) -> Column:
    """The mean step to the pixel below and to the pixel beside, averaged."""
    plain = F.transform(grey, lambda x: x.cast("double"))
    down = F.zip_with(F.slice(plain, width + 1, width * (height - 1)), F.slice(plain, 1, width * (height - 1)), lambda a, b: F.abs(a - b))
    # the last pixel of a row has none beside it
    beside = F.filter(F.transform(plain, lambda x, i: F.when((i + 1) % width != 0, F.abs(F.get(plain, i + 1) - x))), lambda x: x.isNotNull())
    return (_mean(down) + _mean(beside)) / 2


def cosine_rows(size: int, kept: int) -> list[list[float]]:
    """The first rows of the orthonormal cosine transform."""
    return [[sqrt((1 if k == 0 else 2) / size) * cos(pi * (2 * n + 1) * k / (2 * size)) for n in range(size)] for k in range(kept)]


def cosine_block(grey: Column, size: int = 32, kept: int = 8) -> Column:
    """The kept x kept lowest frequencies of a square picture, row by row: two products with a small matrix."""
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in cosine_rows(size, kept)])
    lines = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.transform(F.slice(grey, y * size + 1, F.lit(size)), lambda x: x.cast("double")))
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y))
    # across each line, then down the columns of what that gives
    across = F.transform(rows, lambda row: F.transform(lines, lambda line: dot(line, row)))
    down = lambda columns: F.flatten(F.transform(rows, lambda row: F.transform(columns, lambda column: dot(column, row))))
    return F.get(F.transform(F.array(across), down), F.lit(0))


def cosine_hash(grey: Column, size: int = 32, kept: int = 8) -> Column:
    """A bit for each kept frequency, the first one highest: whether it lies above the median of all but the first row."""

    def bits(block: Column) -> Column:
        rest = F.array_sort(F.slice(block, kept + 1, kept * (kept - 1)))
        n = kept * (kept - 1)
        median = (F.get(rest, F.lit((n - 1) // 2)) + F.get(rest, F.lit(n // 2))) / 2
        return F.get(F.transform(F.array(median), lambda m: F.aggregate(block, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > m).cast("long")))), F.lit(0))

    return F.get(F.transform(F.array(cosine_block(grey, size, kept)), bits), F.lit(0))
