"""Plan algebra: siblings, shifts that push later siblings, validation, coverage of needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predecessors(works: DataFrame, *, plan: str, key: str, ends: str) -> DataFrame:
    """works with n_before and latest_end of their earlier siblings (equal code but for a smaller last number). A window, not a self-join."""
    prefix = F.slice(key, 1, F.size(key) - 1)
    w = Window.partitionBy(plan, prefix).orderBy(F.element_at(key, -1)).rangeBetween(Window.unboundedPreceding, -1)
    return works.withColumn("n_before", F.count(F.lit(1)).over(w)).withColumn("latest_end", F.max(ends).over(w))


def shift(works: DataFrame, *, plan: str, order: Sequence[str], starts: str, ends: str, target: Column, by: float) -> DataFrame:
    """plan, order..., starts, ends, changed: the target ends later by ``by``, and each later sibling starts no sooner than all before it end.

    A sibling group is at most a plan's bounded number of works, so it is an array and the
    recurrence an expression. Durations of pushed works stay.
    """
    work = F.struct(*order, F.col(starts).cast("double").alias("s"), F.col(ends).cast("double").alias("e"), F.coalesce(target, F.lit(False)).alias("t"))
    groups = works.groupBy(plan).agg(F.array_sort(F.collect_list(work)).alias("_w"))
    fields = [F.lit(None).cast(works.schema[o].dataType).alias(o) for o in order]
    out = F.array(F.struct(*fields, F.lit(0.0).alias("s"), F.lit(0.0).alias("e"), F.lit(False).alias("changed")))
    zero = F.struct(F.slice(out, 1, 0).alias("out"), F.lit(None).cast("double").alias("top"), F.lit(False).alias("on"))

    def step(state: Column, x: Column) -> Column:
        push = F.when(state["on"], F.greatest(F.lit(0.0), F.coalesce(state["top"] - x["s"], F.lit(0.0)))).otherwise(0.0)
        s, e = x["s"] + push, x["e"] + push + F.when(x["t"], F.lit(float(by))).otherwise(0.0)
        row = F.struct(*[x[o].alias(o) for o in order], s.alias("s"), e.alias("e"), ((s != x["s"]) | (e != x["e"])).alias("changed"))
        return F.struct(F.concat(state["out"], F.array(row)).alias("out"), F.greatest(state["top"], e).alias("top"), (state["on"] | x["t"]).alias("on"))

    moved = groups.select(plan, F.explode(F.aggregate("_w", zero, step, lambda s: s["out"])).alias("_r"))
    return moved.select(plan, *[f"_r.{o}" for o in order], F.col("_r.s").alias(starts), F.col("_r.e").alias(ends), "_r.changed")


def faults(works: DataFrame, *, plan: str, work: str, starts: str, ends: str, classes: Sequence[str], resources: str) -> DataFrame:
    """works with errors: a repeated id, no positive length, classes that are not the project's."""
    again = F.count(F.lit(1)).over(Window.partitionBy(plan, work)) > 1
    alike = F.array_sort(F.map_keys(resources)) == F.lit(sorted(classes)) if classes else F.lit(True)
    found = [F.when(again, "repeated"), F.when(F.coalesce(F.col(starts) >= F.col(ends), F.lit(True)), "period"), F.when(~F.coalesce(alike, F.lit(False)), "classes")]
    return works.withColumn("errors", F.array_compact(F.array(*found)))


def deficit(measured: DataFrame, *, keys: Sequence[str], need: str = "need", count: str = "count") -> DataFrame:
    """Long form (a row per class) -> missing, ratio and complete per key. A null count is unknown: it adds nothing missing, and leaves the row incomplete."""
    short = F.greatest(F.lit(0), F.col(need) - F.col(count))
    totals = measured.groupBy(*keys).agg(
        F.coalesce(F.sum(short), F.lit(0)).alias("missing"),
        F.sum(need).alias("needed"),
        F.bool_and((F.col(need) <= 0) | F.col(count).isNotNull()).alias("complete"),
    )
    return totals.withColumn("ratio", F.coalesce(F.try_divide("missing", "needed"), F.lit(0.0)))


def coverage(measured: DataFrame, *, keys: Sequence[str], need: str = "need", count: str = "count") -> DataFrame:
    """covered, excess and kinds in excess, with whether any or all counts are known."""
    known = F.col(count).isNotNull()
    return measured.groupBy(*keys).agg(
        F.sum(F.when(known, F.least(F.col(count), F.col(need)))).alias("covered"),
        F.sum(F.when(known, F.greatest(F.lit(0), F.col(count) - F.col(need)))).alias("excess"),
        F.count_if(F.col(count) > F.col(need)).alias("excess_kinds"),
        F.bool_or(known).alias("any_known"),
        F.bool_and(known).alias("all_known"),
    )
