"""Maps before and after, side by side, and inside out, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def changed_entries(before: Column, after: Column) -> Column:
    """The entries of ``after`` that are new or differ: map<key, struct<before, after>>. Keys that are gone are not among them.

    A null value and a missing one are not the same: a key that comes in with null is a change.
    """
    both = F.map_zip_with(before, after, lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    same = lambda k, v: F.map_contains_key(before, k) & v["before"].eqNullSafe(v["after"])
    return F.map_filter(both, lambda k, v: F.map_contains_key(after, k) & ~same(k, v))


def removed_keys(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after)))


def added_items(before: Column, after: Column) -> Column:
    """Of a list that was extended, what is new, in its order; a null list before is an empty one."""
    return F.filter(after, lambda x: ~F.coalesce(F.array_contains(before, x), F.lit(False)))


def by_path(document: Column, depth: int = 3) -> Column:
    """A JSON object as a map from dotted paths to JSON values; objects are opened down to so many levels, lists stay whole. Null for other JSON."""
    kind = "map<string,string>"
    flat = F.from_json(F.when(F.substring(F.ltrim(document), 1, 1) == "{", document), kind)
    for _ in range(depth - 1):
        inner = lambda e: F.from_json(F.when(F.substring(F.ltrim(e["value"]), 1, 1) == "{", e["value"]), kind)
        own = lambda e: F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))
        deeper = lambda e: F.transform(F.map_entries(inner(e)), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        opened = lambda e: F.when(F.size(F.map_keys(inner(e))) > 0, deeper(e)).otherwise(own(e))
        flat = F.map_from_entries(F.flatten(F.transform(F.map_entries(flat), opened)))
    return flat


def counted_classes(kind: Column, expected: Column, counts: Column, classes: Column) -> Column:
    """What an alert shows for each class: class_id, expected, found, missing, excess, idle, sorted by class.

    expected, counts: maps from class to number; classes: array of class_id and count, the
    alert's own finding. Classes of either are shown where the alert's kind concerns them; a
    class that was not counted has neither a deficit nor, but for its own finding, an excess.
    """
    own = F.map_from_entries(F.transform(F.coalesce(classes, F.from_json(F.lit("[]"), "array<struct<class_id:string,count:bigint>>")), lambda c: F.struct(c["class_id"].alias("key"), c["count"].cast("long").alias("value"))))
    nothing = F.from_json(F.lit("{}"), "map<string,bigint>")
    wanted = F.coalesce(expected.cast("map<string,bigint>"), nothing)
    relevant = F.map_zip_with(wanted, own, lambda k, e, n: F.struct(F.coalesce(e, F.lit(0)).alias("expected"), F.coalesce(n, F.lit(0)).alias("finding")))
    seen = F.coalesce(counts.cast("map<string,bigint>"), nothing)
    zipped = F.map_zip_with(relevant, seen, lambda k, r, found: F.struct(r.alias("r"), found.alias("found")))
    kept = F.map_filter(zipped, lambda k, v: v["r"].isNotNull())

    def row(e: Column) -> Column:
        want, found, n = e["value"]["r"]["expected"], e["value"]["found"], e["value"]["r"]["finding"]
        above = F.when(kind == "excess", n).when(found.isNotNull(), F.greatest(F.lit(0), found - want))
        return F.struct(e["key"].alias("class_id"), want.alias("expected"), found.alias("found"), F.when(found.isNotNull(), F.greatest(F.lit(0), want - found)).alias("missing"), above.alias("excess"), n.alias("idle"))

    rows = F.transform(F.map_entries(kept), row)
    shown = lambda r: F.when(kind == "missing", r["missing"]).when(kind == "idle", r["idle"]).otherwise(r["excess"])
    return F.array_sort(F.filter(rows, lambda r: F.coalesce(shown(r), F.lit(0)) > 0))
