"""Distributions, shares and checks of labelled records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groma.sources.scratch import ordered_parts, parts_before


def divergence(df: DataFrame, *, split: str, kind: str, a: str, b: str) -> DataFrame:
    """Jensen-Shannon divergence, in bits, of the kinds' shares in two splits. Only counts by kind go into it."""
    counts = df.groupBy(kind).agg(F.count_if(F.col(split) == a).alias("na"), F.count_if(F.col(split) == b).alias("nb"))
    totals = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    shares = counts.join(F.broadcast(totals)).select((F.col("na") / F.col("ta")).alias("p"), (F.col("nb") / F.col("tb")).alias("q"))  # one row
    middle = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / middle)).otherwise(0.0)
    return shares.agg((F.sum(term("p")) / 2 + F.sum(term("q")) / 2).alias("divergence"))


def summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Percentiles 10, 50, 90 (linear between neighbours), mean and deviation of a whole population.

    Exact, without a group's values in one task: values are counted, the counts laid out by
    range, and running sums taken over the ranges first.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_parts(counts, [group, value], "value-counts")
    before = parts_before(placed, group, F.sum("n"))
    own = Window.partitionBy(group, "part").orderBy(value)
    ranked = placed.join(before, [group, "part"]).withColumn("stop", F.col("before") + F.sum("n").over(own)).withColumn("begin", F.col("stop") - F.col("n"))
    at = lambda r: F.max(F.when((F.col("begin") <= r) & (r < F.col("stop")), F.col(value)))
    found = []
    for p in (10, 50, 90):
        place = (F.col("total") - 1) * (p / 100)
        found += [at(F.floor(place)).alias(f"low{p}"), at(F.ceil(place)).alias(f"high{p}"), F.max(place - F.floor(place)).alias(f"part{p}")]
    percentiles = ranked.groupBy(group).agg(*found)
    moments = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    mixed = [(F.col(f"low{p}") + (F.col(f"high{p}") - F.col(f"low{p}")) * F.col(f"part{p}")).alias(f"p{p}") for p in (10, 50, 90)]
    return moments.join(percentiles, group, "left").select(group, *mixed, "mean", "deviation")


def jaccard(df: DataFrame, *, split: str, value: str, a: str, b: str) -> DataFrame:
    """shared, total and similarity of the values that occur in two splits."""
    seen = df.filter(F.col(split).isin(a, b)).groupBy(value).agg(F.bool_or(F.col(split) == a).alias("in_a"), F.bool_or(F.col(split) == b).alias("in_b"))
    counted = seen.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("similarity", F.try_divide("shared", "total"))


def class_pivot(df: DataFrame, *, kind: str, split: str, record: str, splits: Sequence[str]) -> DataFrame:
    """Objects and distinct records of each kind by split, in columns, in one pass."""
    of = lambda s: F.col(split) == s
    objects = [F.count_if(of(s)).alias(f"{s}_objects") for s in splits]
    records = [F.count_distinct(F.when(of(s), F.col(record))).alias(f"{s}_records") for s in splits]
    return df.groupBy(kind).agg(*objects, *records)


def leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("records")).filter("splits > 1")


def top_share(df: DataFrame, group: str, category: str) -> DataFrame:
    """The most frequent category of each group and its share; ties go to the smaller name."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.min_by(F.struct(category, "n"), F.struct(-F.col("n"), F.col(category))).alias("b"), F.sum("n").alias("total"))
    return best.select(group, F.col(f"b.{category}").alias("top"), F.col("b.n").alias("n"), (F.col("b.n") / F.col("total")).alias("share"))


def prevalence(df: DataFrame, *, kind: str, split: str, a: str, b: str) -> DataFrame:
    """How many times as frequent each kind is in one split as in another, and advice from it; null on an empty base."""
    n = df.groupBy(kind).agg(F.count_if(F.col(split) == a).alias("na"), F.count_if(F.col(split) == b).alias("nb"))
    ratio = F.try_divide(F.col("na"), F.col("nb"))
    advice = F.when(ratio.isNull(), "no base").when(ratio < 0.5, "add").when(ratio > 2, "thin out").otherwise("keep")
    return n.withColumn("ratio", ratio).withColumn("advice", advice)
