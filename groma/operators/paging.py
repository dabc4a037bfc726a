"""Pages of ordered results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groma.operators.ordered import Ordered


def keyset_page(df: DataFrame, order: Sequence[str], limit: int, after: Sequence | None = None) -> DataFrame:
    """The next rows in descending order after a cursor of values; a shorter cursor compares by its own columns alone."""
    if after:
        df = df.filter(F.struct(*order[: len(after)]) < F.struct(*[F.lit(x).cast(df.schema[c].dataType).alias(c) for x, c in zip(after, order, strict=False)]))
    return df.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(limit)


def budget_page(df: DataFrame, order: Sequence[str], size: str, budget: int, group: str) -> DataFrame:
    """Of each group the longest prefix whose sizes add up to the budget at most; the first row always."""
    w = Window.partitionBy(group).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_total", total).withColumn("_at", F.row_number().over(w)).filter((F.col("_at") == 1) | (F.col("_total") <= budget)).drop("_total", "_at")


def offset_page(df: DataFrame, order: Sequence[str], *, size: int, offset: int) -> DataFrame:
    """A page and next_offset, null on the last one: one row more than the page is looked at."""
    page = df.orderBy(*order).offset(offset).limit(size + 1)
    held = page.withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # at most size + 1 rows
    more = held.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return more.filter(F.col("_place") <= size).withColumn("next_offset", F.when(F.col("_n") > size, offset + size)).drop("_place", "_n")


def bounded_scan(df: DataFrame, *, group: str, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in an order without ties, with truncated: whether the group has more. A group of any length is spread over tasks."""
    placed = Ordered.of(df, [group], list(order)).numbered("_at", "_n").done()
    return placed.filter(F.col("_at") <= most).withColumn("truncated", F.col("_n") > most).drop("_at", "_n")


def listed_place(value: Column, listed: Sequence[str]) -> Column:
    """Place of a value in a given list, from 1; values that are not in it come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in listed]), value)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(listed) + 1).cast("int")


def united(pages: Sequence[DataFrame], key: str) -> DataFrame:
    """All pages as one table without repeated keys."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.dropDuplicates([key])
