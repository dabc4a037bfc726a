"""From a detector's raw output to boxes: thresholds, classes, letterboxes, tiles and their seams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groma.functions.geometry import area, clipped, overlap

#: A frame is usable between these brightnesses and above this sharpness.
DARKEST, BRIGHTEST, SHARPNESS = 12, 248, 2


def usable(brightness: Column, sharpness: Column) -> Column:
    return (brightness > DARKEST) & (brightness < BRIGHTEST) & (sharpness > SHARPNESS)


def best_class(scores: Column, names: Sequence[str], *, least: float) -> Column:
    """class_id and score of the highest score, the first of equal ones; null below ``least``."""
    top = F.array_max(scores)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(scores, top).cast("int"))
    return F.when(top >= least, F.struct(name.alias("class_id"), top.alias("score")))


def unletterboxed(pixels: Column, *, width: int, height: int, side: int) -> Column:
    """Corners x1, y1, x2, y2 on a padded square of ``side`` pixels -> a box in [0, 1] of the frame; null if nothing of it is left."""
    scale = min(side / width, side / height)
    wide, high = width * scale, height * scale
    left, top = (side - wide) / 2, (side - high) / 2
    at = lambda i, pad, size: (F.get(pixels, F.lit(i)) - pad) / size
    return clipped(F.struct(at(0, left, wide).alias("x1"), at(1, top, high).alias("y1"), at(2, left, wide).alias("x2"), at(3, top, high).alias("y2")))


def centred(x: Column, y: Column, w: Column, h: Column, *, width: int, height: int) -> Column:
    """A box of pixels (corner and size), cut at the frame's edges -> centre and size in [0, 1]; null if nothing is left."""
    x1, y1 = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    x2, y2 = F.least(F.lit(float(width)), x + w), F.least(F.lit(float(height)), y + h)
    made = F.struct(((x1 + x2) / 2 / width).alias("x"), ((y1 + y2) / 2 / height).alias("y"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"))
    return F.when((x2 > x1) & (y2 > y1), made)


def strongest(detections: DataFrame, *, frame: str, score: str, row: str, most: int) -> DataFrame:
    """The ``most`` detections of each frame with the highest scores. A frame's detections are bounded by the detector."""
    held = detections.groupBy(frame).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("order"), F.col(row).alias("row")))), 1, most).alias("best"))
    return held.select(frame, F.explode("best").alias("b")).select(frame, F.col("b.row").alias(row), (-F.col("b.order")).alias(score))


def starts(size: Column, *, side: int, step: int) -> Column:
    """Where tiles begin along one direction: every ``step``, the last one moved back to end with the frame."""
    last = F.greatest(size - side, F.lit(0))
    count = F.ceil(F.greatest(size - side, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.least(i * step, last))


def tiles(width: Column, height: Column, *, side: int, step: int) -> Column:
    """All tiles of a frame, row by row: array of x1, y1, x2, y2."""
    one = lambda x, y: F.struct(x.alias("x1"), y.alias("y1"), F.least(x + side, width).alias("x2"), F.least(y + side, height).alias("y2"))
    return F.flatten(F.transform(starts(height, side=side, step=step), lambda y: F.transform(starts(width, side=side, step=step), lambda x: one(x, y))))


def over_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller box; 0 where that is empty."""
    return F.coalesce(F.try_divide(overlap(a, b), F.least(area(a), area(b))), F.lit(0.0))


def merged_over_seams(detections: DataFrame, *, frame: str, kind: str, box: str, score: str, row: str, tile: str, at_edge: str, least: float) -> DataFrame:
    """Parts of one thing that tiles have cut: by falling score, a box joins the first kept one of its frame and class from
    another tile if both lie at an inner edge and the overlap is at least ``least`` of the smaller; the kept box grows to hold both.

    A frame's boxes are bounded by the detector, so they are one array and the fold an expression.
    """
    item = F.struct((-F.col(score)).alias("order"), F.col(row).alias("row"), F.col(tile).alias("tile"), F.col(at_edge).alias("at_edge"), F.col(box).alias("box"), F.lit(1).alias("parts"))
    held = detections.groupBy(frame, kind).agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))

    def add(kept: Column, x: Column) -> Column:
        fits = lambda k: k["at_edge"] & x["at_edge"] & (k["tile"] != x["tile"]) & (over_smaller(k["box"], x["box"]) >= least)
        at = F.array_position(F.transform(kept, fits), True)
        both = lambda k: F.struct(F.least(k["box"]["x1"], x["box"]["x1"]).alias("x1"), F.least(k["box"]["y1"], x["box"]["y1"]).alias("y1"), F.greatest(k["box"]["x2"], x["box"]["x2"]).alias("x2"), F.greatest(k["box"]["y2"], x["box"]["y2"]).alias("y2"))
        grown = lambda k: F.struct(k["order"].alias("order"), k["row"].alias("row"), k["tile"].alias("tile"), k["at_edge"].alias("at_edge"), both(k).alias("box"), (k["parts"] + 1).alias("parts"))
        return F.when(at > 0, F.transform(kept, lambda k, i: F.when(i == at - 1, grown(k)).otherwise(k))).otherwise(F.concat(kept, F.array(x)))

    merged = held.select(frame, kind, F.explode(F.aggregate("all", none, add)).alias("k"))
    return merged.select(frame, kind, F.col("k.row").alias(row), (-F.col("k.order")).alias(score), F.col("k.box").alias(box), F.col("k.parts").alias("parts"))
