"""Boxes and polygons as column expressions. Boxes are structs x1, y1, x2, y2; polygons arrays of structs x, y."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-9


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return wide * high


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def clipped(box: Column) -> Column:
    """The box within the unit square; null if nothing of it is left."""
    edge = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    inner = F.struct(*[edge(box[k]).alias(k) for k in ("x1", "y1", "x2", "y2")])
    return F.when((inner["x2"] > inner["x1"]) & (inner["y2"] > inner["y1"]), inner)


def anchor(box: Column) -> Column:
    """Where a thing stands: the middle of the box's lower edge."""
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), box["y2"].alias("y"))


def _edges(polygon: Column) -> Column:
    return F.transform(polygon, lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get(polygon, i + 1), F.get(polygon, F.lit(0))).alias("b")))


def inside(point: Column, polygon: Column) -> Column:
    """Even-odd rule; points on an edge (within 1e-9) are inside."""
    x, y = point["x"], point["y"]

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        within = lambda v, s, t: v.between(F.least(s, t) - EDGE, F.greatest(s, t) + EDGE)
        return (F.abs(cross) <= EDGE) & within(x, a["x"], b["x"]) & within(y, a["y"], b["y"])

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    edges = _edges(polygon)
    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def inside_fixed(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """As ``inside``, for a polygon that is known when the query is planned: plain arithmetic for each edge, behind a test of the bounds."""
    lit = lambda v: F.lit(float(v))
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    on_edge, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        cross = lit(bx - ax) * (y - ay) - lit(by - ay) * (x - ax)
        on_edge = on_edge | ((F.abs(cross) <= EDGE) & x.between(min(ax, bx) - EDGE, max(ax, bx) + EDGE) & y.between(min(ay, by) - EDGE, max(ay, by) + EDGE))
        if ay != by:
            crossed = ((lit(ay) > y) != (lit(by) > y)) & (x < lit(ax) + (y - ay) * lit(bx - ax) / lit(by - ay))
            crossings = crossings + crossed.cast("int")
    near = x.between(min(xs) - EDGE, max(xs) + EDGE) & y.between(min(ys) - EDGE, max(ys) + EDGE)
    return near & (on_edge | (crossings % 2 == 1))


def polygon_area(polygon: Column) -> Column:
    """Shoelace formula."""
    terms = F.transform(_edges(polygon), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def smoothed(before: Column, now: Column, weight: float = 0.5) -> Column:
    """Exponential mean of a velocity; the new one alone where there is none before."""
    return F.coalesce(before * (1 - weight) + now * weight, now)


def ahead(box: Column, vx: Column, vy: Column, seconds: Column, most: float = 2.0) -> Column:
    """The box where it is expected after some seconds, of which at most ``most`` count."""
    t = F.least(F.greatest(seconds, F.lit(0.0)), F.lit(most))
    return F.struct((box["x1"] + vx * t).alias("x1"), (box["y1"] + vy * t).alias("y1"), (box["x2"] + vx * t).alias("x2"), (box["y2"] + vy * t).alias("y2"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays of numbers; null where one of them is constant."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = lambda u, v: total(F.zip_with(u, v, lambda x, y: x.cast("double") * y))
    sa, sb = total(F.transform(a, lambda x: x.cast("double"))), total(F.transform(b, lambda x: x.cast("double")))
    cov = dot(a, b) - sa * sb / n
    spread = F.sqrt((dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n))
    return F.try_divide(cov, spread)


def difference_hash(row: Column) -> Column:
    """64 bits of 65 brightnesses: whether each is above its right neighbour; the first comparison is the highest bit, a missing neighbour gives 0."""
    signs = F.zip_with(F.slice(row, 1, 64), F.slice(row, 2, 64), lambda a, b: F.coalesce((a > b).cast("long"), F.lit(0).cast("long")))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
