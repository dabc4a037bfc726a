"""Evaluation of frames: what is seen in a zone against what the plan says should be there.

A null count is "not measurable" (class unsupported, frame unusable, zone not visible), a
zero is "measured, none"; only a work of which every needed class is measured can be short
of something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groma.functions import geometry
from groma.operators import joins
from groma.sources.scratch import written


def located(detections: DataFrame, wanted: DataFrame, regions: DataFrame) -> DataFrame:
    """Detections with each wanted region of their frame (frame_id, region_id) that holds their anchor, the middle of the box's lower edge.

    The equi-join by frame comes first, then a comparison with the polygon's bounds, and only
    what lies within them is tested edge by edge.
    """
    at = geometry.anchor(F.col("box"))
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    edge = 1e-9
    bounded = regions.select("region_id", "polygon", *[f(v).alias(n) for n, f, v in (("x_min", F.array_min, xs), ("x_max", F.array_max, xs), ("y_min", F.array_min, ys), ("y_max", F.array_max, ys))])
    near = detections.join(wanted.join(bounded, "region_id"), "frame_id").filter(at["x"].between(F.col("x_min") - edge, F.col("x_max") + edge) & at["y"].between(F.col("y_min") - edge, F.col("y_max") + edge))
    return near.filter(geometry.inside(at, F.col("polygon"))).drop("polygon", "x_min", "x_max", "y_min", "y_max")


def local_counts(found: DataFrame) -> DataFrame:
    """frame_id, region_id, class_id, n, n_idle: things that are held from an earlier frame count as seen, but not as idle."""
    idle = (F.col("activity") == "idle") & F.coalesce(F.col("observed"), F.lit(True))
    return found.groupBy("frame_id", "region_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(idle).alias("n_idle"))


def evaluate(frames: DataFrame, detections: DataFrame, works: DataFrame, resources: DataFrame, regions: DataFrame, bindings: DataFrame, *, width: int) -> DataFrame:
    """A row for each frame, region and active work that is bound to it.

    frames: frame_id, plan_id, at, usable, supported. detections: frame_id, class_id, box,
    activity, observed. works: plan_id, work_id, starts, ends, done. resources: work_id,
    class_id, need. regions: region_id, polygon, visible. bindings: work_id, region_id.
    Returns readiness, missing, needed, missing_ratio (of complete rows), excess (things of
    which there are too many and that no other active work explains), n_idle, and idle, the
    idle things by class: an array of class_id and count, sorted, null where nothing is seen.
    """
    active = joins.interval_join(frames, works.filter("NOT done"), key="plan_id", at="at", starts="starts", ends="ends", width=width)
    assigned = active.join(bindings, "work_id").join(regions.select("region_id", "visible"), "region_id").select("frame_id", "region_id", "work_id", "usable", "visible", "supported")
    assigned = written(assigned, "assigned")  # three joins read it
    wanted = assigned.select("frame_id", "region_id").distinct()
    counts = local_counts(located(detections, wanted, regions))
    keys = ["frame_id", "region_id", "work_id"]
    measurable = F.array_contains("supported", F.col("class_id")) & F.col("usable") & F.col("visible")
    spine = assigned.join(resources, "work_id").join(counts.drop("n_idle"), ["frame_id", "region_id", "class_id"], "left")
    counted = spine.withColumn("count", F.when(measurable, F.coalesce("n", F.lit(0))))
    # an excess is explained if another work needs the class in a region where it is seen: one row for each frame and class tells
    explain = counted.filter("need > 0 AND n > 0").groupBy("frame_id", "class_id").agg(F.min("work_id").alias("w_min"), F.max("work_id").alias("w_max"))
    judged = counted.join(explain, ["frame_id", "class_id"], "left").withColumn("explained", F.coalesce((F.col("w_min") != F.col("work_id")) | (F.col("w_max") != F.col("work_id")), F.lit(False)))
    over = F.when((F.col("count") > F.col("need")) & ~F.col("explained"), F.col("count") - F.col("need")).otherwise(0)
    totals = judged.groupBy(*keys).agg(
        F.sum(F.when(F.col("count").isNotNull(), F.greatest(F.lit(0), F.col("need") - F.col("count"))).otherwise(0)).alias("short"),
        F.sum("need").alias("needed"),
        F.bool_and((F.col("need") <= 0) | F.col("count").isNotNull()).alias("complete"),
        F.sum(over).alias("excess"),
    )
    resting = F.array_sort(F.collect_list(F.when(F.col("n_idle") > 0, F.struct("class_id", F.col("n_idle").alias("count")))))
    idle = counts.groupBy("frame_id", "region_id").agg(F.sum("n_idle").alias("n_idle"), resting.alias("idle"))
    none = F.array().cast("array<struct<class_id:string,count:bigint>>")
    joined = assigned.drop("supported").join(totals, keys, "left").join(idle, ["frame_id", "region_id"], "left")
    seen = F.col("usable") & F.col("visible")
    return joined.select(
        *keys,
        F.when(F.coalesce("complete", F.lit(True)) & seen, "ready").otherwise("insufficient_evidence").alias("readiness"),
        F.when(F.col("complete"), F.col("short")).alias("missing"),
        F.coalesce("needed", F.lit(0)).alias("needed"),
        F.when(F.col("complete"), F.coalesce(F.try_divide(F.col("short"), F.col("needed")), F.lit(0.0))).alias("missing_ratio"),
        F.coalesce("excess", F.lit(0)).alias("excess"),
        F.when(seen, F.coalesce("n_idle", F.lit(0))).alias("n_idle"),
        F.when(seen, F.coalesce("idle", none)).alias("idle"),
    )


def snapshot(runs: DataFrame, versions: DataFrame, *, plan: str = "plan_id", version: str = "version") -> DataFrame:
    """Runs with the plan version that they were started with, not the current one; runs whose version is gone stay, with nulls."""
    return runs.join(versions, [plan, version], "left")
