"""Versions of plans and what changes them: publishing, early starts, presets, imports, bindings, phases of works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def published(requests: DataFrame, versions: DataFrame, *, plan: str = "plan_id", base: str = "base") -> DataFrame:
    """requests with current (0 without any version), outcome and new version: a request made on another version than the current one is a conflict."""
    newest = versions.groupBy(plan).agg(F.max("version").alias("current"))
    joined = requests.join(newest, plan, "left").withColumn("current", F.coalesce("current", F.lit(0)))
    fits = F.coalesce(F.col(base) == F.col("current"), F.lit(False))
    return joined.withColumn("outcome", F.when(fits, "published").otherwise("conflict")).withColumn("version", F.when(fits, F.col("current") + 1))


def started_early(starts: Column, at: Column, zone: str) -> Column:
    """The start that holds once a work has begun: the actual time if its local day lies before the planned one, else the plan's."""
    day = lambda t: F.to_date(F.from_utc_timestamp(t, zone))
    return F.when(day(at) < day(starts), at).otherwise(starts)


def preset(resources: Column, *, aliases: Mapping[str, str], zeroed: Column, overrides: Mapping[str, int]) -> Column:
    """Counts by class: aliased classes are added to what they stand for, all are 0 where ``zeroed`` holds, overrides come last."""
    pairs = F.map_entries(resources)
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    named = F.transform(pairs, lambda e: F.struct(F.coalesce(F.try_element_at(alias, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.array_sort(F.array_distinct(F.transform(named, lambda e: e["key"])))
    total = lambda k: F.aggregate(F.filter(named, lambda e: e["key"] == k), F.lit(0), lambda a, e: a + e["value"])
    fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    value = lambda k: F.coalesce(F.try_element_at(fixed, k), F.when(zeroed, 0).otherwise(total(k)))
    return F.map_from_arrays(keys, F.transform(keys, value))


def identified(rows: DataFrame, known: DataFrame, *, plan: str = "plan_id", code: str = "code", title: str = "title", work: str = "work_id") -> DataFrame:
    """Imported rows with the id they keep: by code, else by a title that one known work alone has, else null; ``matched`` says by what."""
    by_code = known.groupBy(plan, code).agg(F.min(work).alias("of_code"))
    by_title = known.groupBy(plan, title).agg(F.min(work).alias("of_title"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    joined = rows.join(by_code, [plan, code], "left").join(by_title, [plan, title], "left")
    how = F.when(F.col("of_code").isNotNull(), "code").when(F.col("of_title").isNotNull(), "title").otherwise("new")
    return joined.withColumn(work, F.coalesce("of_code", "of_title")).withColumn("matched", how).drop("of_code", "of_title")


def rebound(regions: DataFrame, works: DataFrame, *, source: str = "source_id", region: str = "region_id", ids: str = "work_ids", plan_works: str = "plan_works") -> DataFrame:
    """Bindings brought to the current plan: unknown works go, regions without works go, and works bound nowhere get a region of the whole frame (null region).

    works: one row for each source with the array of the current plan's works, bounded by a plan's size.
    """
    known = regions.join(works, source).withColumn(ids, F.array_intersect(ids, plan_works))
    kept = known.filter(F.size(ids) > 0).select(source, region, ids)
    bound = kept.groupBy(source).agg(F.array_distinct(F.flatten(F.collect_list(ids))).alias("bound"))
    left = works.join(bound, source, "left").withColumn(ids, F.array_except(plan_works, F.coalesce("bound", F.array().cast(works.schema[plan_works].dataType))))
    free = left.filter(F.size(ids) > 0).select(source, F.lit(None).cast(regions.schema[region].dataType).alias(region), ids)
    return kept.unionByName(free)


def phase(status: Column, starts: Column, ends: Column, now: Column) -> Column:
    """A work's phase: its own state first, then the schedule."""
    return F.when(status == "completed", "completed").when(status == "in_progress", "active").when(now < starts, "upcoming").when(now < ends, "active").otherwise("overdue")


def first_by(df: DataFrame, keys: Sequence[str], priority: Sequence[Column], value: str) -> DataFrame:
    """The value of each group that comes first: by priorities (false before true is last: conditions are met first), then by itself."""
    order = [F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1) for p in priority]
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(*[o.alias(f"p{i}") for i, o in enumerate(order)], F.col(value).alias("v"))).alias(value))


def changed_context(before: Mapping[str, Column], after: Mapping[str, Column], defaults: Mapping[str, Column]) -> Column:
    """Whether any setting differs, where a missing one counts as its default."""
    out = F.lit(False)
    for name, default in defaults.items():
        out = out | ~F.coalesce(before[name], default).eqNullSafe(F.coalesce(after[name], default))
    return out
