"""Splits of a data set by whole components, greedily by remaining need.

The rarest classes are placed first: a component belongs to the round of the rarest class
that it holds. In a round, components follow each other from the fullest in the class to the
least, in an order of hashes among equals, and each split takes as much as it still needs of
the class; what a split needs is its share less all that earlier rounds gave it. Within a
round, running sums come from ranges, so a class with most of the components is many tasks;
what the rounds share is a table with a number for each split and class. At the end, a class
that a split lacks, though three components hold it, gets the smallest component whose move
takes the last of nothing else away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groma.sources.scratch import ordered_parts, parts_before, written

#: A class is spread over all splits from so many components on.
LEAST_COMPONENTS = 3


def hashed(component: Column, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), component.cast("string"))


def assigned(counts: DataFrame, *, shares: Sequence[tuple[str, float]], component: str = "component", kind: str = "class_id", n: str = "n", weight: str = "weight", seed: str = "1") -> DataFrame:
    """component, split. counts: a row for each component and class with n records of it; weight: the component's records. Components without a class have one row with a null class."""
    plain = counts.select(F.col(component).alias("component"), F.col(kind).alias("kind"), F.col(n).alias("n"), F.col(weight).alias("weight"))
    counts = written(plain, "counts")
    kinds = counts.filter("kind is not null").groupBy("kind").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("components")).orderBy("total", "kind").collect()
    order = {r.kind: i for i, r in enumerate(kinds)}
    spelled = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)]) if order else None
    place = F.coalesce(F.try_element_at(spelled, F.col("kind")), F.lit(len(order))) if order else F.lit(0)
    rounds = counts.groupBy("component").agg(F.min_by(F.struct("kind", "n"), place).alias("own"), F.min(place).alias("round"), F.first("weight").alias("weight"))
    rounds = written(rounds.select("component", "round", "own.n", "weight"), "rounds")
    placed = None
    for i in range(len(order) + 1):
        kind_now = kinds[i].kind if i < len(order) else None
        amount = F.col("n") if kind_now is not None else F.col("weight")
        here = rounds.filter(F.col("round") == i).withColumn("amount", amount)
        given = _given(placed, counts, rounds, kind_now)
        here = _shared(here, shares, given, seed)
        placed = here if placed is None else written(placed.unionByName(here), "placed")
    return _repaired(written(placed, "placed"), counts, kinds, [s for s, _ in shares]).select(F.col("component").alias(component), "split")


def _given(placed: DataFrame | None, counts: DataFrame, rounds: DataFrame, kind: object) -> dict[str, float]:
    """What each split holds of a class (null: of all records)."""
    if placed is None:
        return {}
    if kind is None:
        rows = placed.join(rounds.select("component", F.col("weight").alias("n")), "component")
    else:
        rows = placed.join(counts.filter(F.col("kind") == F.lit(kind)).select("component", "n"), "component")
    return {r.split: float(r.n) for r in rows.groupBy("split").agg(F.sum("n").alias("n")).collect()}


def _shared(here: DataFrame, shares: Sequence[tuple[str, float]], given: dict[str, float], seed: str) -> DataFrame:
    """component, split of a round's components: each split gets what it needs, beginning where the one before it ends."""
    own = here.withColumn("less", -F.col("amount")).withColumn("hash", hashed(F.col("component"), seed)).withColumn("all", F.lit(1))
    rows = ordered_parts(own, ["less", "hash", "component"], "round")
    before = parts_before(rows, "all", F.sum("amount"))
    total = before.agg(F.max("total")).first()[0]
    if not total:
        return rows.select("component", F.lit(shares[0][0]).alias("split"))
    whole = float(total) + sum(given.values())
    needs = {name: max(0.0, share * whole - given.get(name, 0.0)) for name, share in shares}
    scale = float(total) / (sum(needs.values()) or 1.0)
    reached = F.col("before") + F.sum("amount").over(Window.partitionBy("part").orderBy("less", "hash", "component")) - F.col("amount") / 2
    # large components are dealt like small ones: every split takes its part of each stretch of equal amounts
    at = F.pmod(reached / float(total) * _turns(total), F.lit(1.0))
    bound, split = 0.0, None
    for name, need in needs.items():
        bound += need * scale / float(total)
        split = F.when(at < bound, name) if split is None else split.when(at < bound, name)
    return rows.join(before, ["all", "part"]).select("component", split.otherwise(max(needs, key=needs.get)).alias("split"))


def _turns(total: float) -> float:
    """How often the splits take turns along a round's components: more often, the more there is to share."""
    return float(max(1, min(64, int(total) // 50)))


def _repaired(placed: DataFrame, counts: DataFrame, kinds: list, splits: Sequence[str]) -> DataFrame:
    """placed with components moved to splits that lack a class; a few rows a round, at most one move for each class and split."""
    wide = [r.kind for r in sorted(kinds, key=lambda r: (r.components, str(r.kind))) if r.components >= LEAST_COMPONENTS]
    moved: dict[object, str] = {}
    now, held, there = placed, None, set()
    for kind in wide:
        for split in reversed(splits):
            if held is None:
                # what splits hold changes with a move alone, so it is worked out again only then
                now = _moved(placed, moved)
                held = counts.join(now, "component").filter("kind is not null").groupBy("kind", "split").agg(F.sum("n").alias("held"))
                held = written(held, "held")
                there = {(r.kind, r.split) for r in held.select("kind", "split").collect()}
            if (kind, split) in there:
                continue
            mine = counts.join(now, "component").join(held, ["kind", "split"])
            spare = mine.withColumn("last", (F.col("held") <= F.col("n")) & F.col("kind").isin(wide))
            whole = spare.groupBy("component", "split").agg(F.max("last").alias("last"), F.max(F.col("kind") == F.lit(kind)).alias("has"), F.first("weight").alias("weight"))
            found = whole.filter(F.col("has") & ~F.col("last") & (F.col("split") != split)).orderBy("weight", "component").head()
            if found:
                moved[found.component] = split
                held = None
    return _moved(placed, moved)


def _moved(placed: DataFrame, moved: dict) -> DataFrame:
    if not moved:
        return placed
    names = F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])
    return placed.withColumn("split", F.coalesce(F.try_element_at(names, F.col("component")), F.col("split")))
