"""Labelled records: class maps, edits, matches in stages, splits without leaks, and checks of what was written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groma.functions.geometry import iou


def canonical(raw: Column, names: Mapping[str, str | None]) -> Column:
    """The class that a raw name stands for; null for names that are to be dropped, and for unknown ones."""
    known = {k: v for k, v in names.items() if v is not None}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), raw)


def frequent_classes(objects: DataFrame, *, kind: str, record: str, least: int) -> DataFrame:
    """Objects of classes that occur in at least ``least`` records. Only the classes' names are joined back."""
    kept = objects.groupBy(kind).agg(F.count_distinct(record).alias("_n")).filter(F.col("_n") >= least).select(kind)
    return objects.join(kept, kind, "left_semi")


def chosen(classes: Column, *, required: Sequence[str], dropped: Sequence[str]) -> Column:
    """Whether a record has one of the required classes and none of the dropped ones."""
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    return F.arrays_overlap(classes, listed(required)) & ~F.arrays_overlap(classes, listed(dropped))


def edited(labels: DataFrame, edits: DataFrame, *, key: Sequence[str], kind: str = "class_id") -> DataFrame:
    """Labels after review. edits: key, action (drop, set) and new class; returns before, after (null: gone) and change."""
    joined = labels.join(edits.select(*key, "action", F.col(kind).alias("_new")), list(key), "left")
    after = F.when(F.col("action") == "drop", F.lit(None)).when(F.col("action") == "set", F.col("_new")).otherwise(F.col(kind))
    change = F.when(F.col("action") == "drop", "dropped").when((F.col("action") == "set") & (F.col("_new") != F.col(kind)), "changed").otherwise("kept")
    return joined.select(*key, F.col(kind).alias("before"), after.alias("after"), change.alias("change"))


def matched_in_stages(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, keys: Sequence[str]) -> DataFrame:
    """left_id, right_id, stage: by the first key that one record alone of the right side has; what a stage has matched takes no part in later ones."""
    out, rest = None, left
    for stage in keys:
        alone = right.filter(F.col(stage).isNotNull()).groupBy(stage).agg(F.min(right_id).alias("_to"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
        met = rest.join(alone, stage).select(left_id, F.col("_to").alias(right_id), F.lit(stage).alias("stage"))
        out = met if out is None else out.unionByName(met)
        rest = rest.join(met.select(left_id), left_id, "left_anti")
    return out


def merged_reports(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    rest = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*rest).alias("_old")).join(new.select(key, F.struct(*rest).alias("_new")), key, "full")
    return both.select(key, F.coalesce("_new", "_old").alias("_r")).select(key, "_r.*")


def stratified(components: DataFrame, *, component: str, weight: str, stratum: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """component, split: every component whole in one split, each stratum (say, a component's rarest class) divided by weight as the shares say.

    Within a stratum components follow each other by a hash of their names. The running sum
    is taken over buckets of the hash first, so that no stratum is sorted in one task.
    """
    order = F.conv(F.substring(F.md5(F.col(component).cast("string").cast("binary")), 1, 13), 16, 10).cast("long")
    placed = components.withColumn("_order", order).withColumn("_bucket", F.floor(F.col("_order") / 2.0**42))  # 1024 buckets
    sums = placed.groupBy(stratum, "_bucket").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(stratum).orderBy("_bucket")
    before = sums.withColumn("_before", F.sum("_w").over(w) - F.col("_w")).withColumn("_all", F.sum("_w").over(Window.partitionBy(stratum))).drop("_w")
    own = Window.partitionBy(stratum, "_bucket").orderBy("_order", component)
    at = (F.col("_before") + F.sum(weight).over(own) - F.col(weight) / 2) / F.col("_all")
    total, out = 0.0, None
    for name, share in shares[:-1]:
        total += share
        out = F.when(at < total, name) if out is None else out.when(at < total, name)
    named = out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])
    return placed.join(before, [stratum, "_bucket"]).select(component, stratum, weight, named.alias("split"))


def sampled(df: DataFrame, *, group: str, record: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` records of each group, those of the smallest hash of seed, group and name; the same ones on every run."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col(record).cast("string")).cast("binary"))
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(order, record))).filter(F.col("_place") <= most).drop("_place")


def monotone(df: DataFrame, *, run: str, clock: str, row: str) -> DataFrame:
    """Per run: rows, whether the clock always rises, and the largest step."""
    step = F.col(clock) - F.lag(clock).over(Window.partitionBy(run).orderBy(row))
    return df.withColumn("_step", step).groupBy(run).agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.coalesce(F.col("_step") > 0, F.lit(True))).alias("rising"), F.max("_step").alias("largest"))


def mismatches(manifest: DataFrame, actual: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys whose written values differ from those counted anew, or that one side lacks."""
    a = manifest.select(key, *[F.col(v).alias(f"written_{v}") for v in values])
    b = actual.select(key, *[F.col(v).alias(f"counted_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"written_{v}").eqNullSafe(F.col(f"counted_{v}"))
    return a.join(b, key, "full").filter(differs)


def doubled_boxes(boxes: DataFrame, *, record: str, kind: str, box: str, row: str, same: float = 0.90, other: float = 0.75) -> DataFrame:
    """Boxes of records that hold the same picture, united in the order of ``row``: one that overlaps a kept box of its class by
    ``same`` or more is a double and goes, one that overlaps a kept box of another class by ``other`` or more stays and marks a conflict.

    A record's boxes are bounded by its labels, so they are one array and the fold an expression.
    """
    held = boxes.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("row"), F.col(kind).alias("kind"), F.col(box).alias("box"), F.lit(False).alias("conflict")))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))

    def add(kept: Column, x: Column) -> Column:
        double = F.exists(kept, lambda k: (k["kind"] == x["kind"]) & (iou(k["box"], x["box"]) >= same))
        conflict = F.exists(kept, lambda k: (k["kind"] != x["kind"]) & (iou(k["box"], x["box"]) >= other))
        return F.when(double, kept).otherwise(F.concat(kept, F.array(F.struct(x["row"].alias("row"), x["kind"].alias("kind"), x["box"].alias("box"), conflict.alias("conflict")))))

    return held.select(record, F.explode(F.aggregate("all", none, add)).alias("k")).select(record, F.col("k.row").alias(row), F.col("k.kind").alias(kind), "k.conflict")


def without_parents(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What is left of a table when its parents are deleted."""
    return children.join(gone.select(key).distinct(), key, "left_anti")


def grid_samples(df: DataFrame, *, run: str, clock: str, row: str, start: float, step: float, end: float | None = None) -> DataFrame:
    """The first row of each step from ``start`` on, the end exclusive: samples that do not drift."""
    within = df.filter(F.col(clock) >= start) if end is None else df.filter((F.col(clock) >= start) & (F.col(clock) < end))
    held = within.groupBy(run, F.floor((F.col(clock) - start) / step).alias("tick"))
    return held.agg(F.min(F.struct(clock, row)).alias("_r")).select(run, "tick", f"_r.{clock}", f"_r.{row}")
