"""Joins: by interval, latest rows, counts with a left side kept, orphans, near bit patterns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groma.operators.ordered import Ordered

#: Rows of a block of bit patterns, and comparisons of a block that are held at once.
HAMMING_BLOCK, HAMMING_CELLS = 8192, 1 << 19


def interval_join(points: DataFrame, intervals: DataFrame, *, key: str, at: str, starts: str, ends: str, width: int) -> DataFrame:
    """Points with the intervals [starts, ends) that hold them, by equal keys and numbered stretches of time.

    at, starts and ends are numbers. An interval is posted under each stretch of ``width``
    that it touches, so the join is an equi-join and a key with most of the rows is spread.
    """
    stretch = lambda c: F.floor(c / width)
    posted = intervals.filter(F.col(ends) > F.col(starts)).withColumn("_stretch", F.explode(F.sequence(stretch(F.col(starts)), stretch(F.col(ends) - 1))))
    placed = points.withColumn("_stretch", stretch(F.col(at)))
    return placed.join(posted, [key, "_stretch"]).filter((F.col(at) >= F.col(starts)) & (F.col(at) < F.col(ends))).drop("_stretch")


def latest_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each group that is greatest by the order columns, with partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")


def matched_counts(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """group, total, matched: rows of left, and those among them with a partner in right (unique by key)."""
    own = right.select(key).distinct().withColumn("_there", F.lit(1))
    return left.join(own, key, "left").groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count("_there").alias("matched"))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side that lacks them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("absent", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("absent", F.lit("left")))


def sign_bits(vector: Column) -> Column:
    """The signs of at most 64 numbers as one number; the first of 64 is its sign bit."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("long")))


def hamming_pairs(df: DataFrame, *, key: str, bits: str, most: int, width: int = 64) -> DataFrame:
    """a, b, distance: pairs of keys that differ in at most ``most`` bits.

    The bits are cut into most + 1 bands; such a pair is equal in one of them at least, so
    only patterns with a band in common are compared, each pair under its first common band.
    The rows of a band's value are dealt into blocks, and each two blocks are a group of
    their own: a task holds two blocks, and its pairs leave it in small batches.
    """
    n = most + 1
    cuts = [width * i // n for i in range(n + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    band = lambda c, i: F.shiftrightunsigned(c, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(bits).alias("_bits")).filter("_key is not null and _bits is not null")
    posted = rows.select("_key", "_bits", F.posexplode(F.array(*[band(F.col("_bits"), i) for i in range(n)])).alias("_band", "_value"))
    blocks = posted.groupBy("_band", "_value").agg(F.ceil(F.count(F.lit(1)) / HAMMING_BLOCK).cast("int").alias("_blocks"))
    own = posted.join(blocks, ["_band", "_value"]).withColumn("_own", F.pmod(F.xxhash64("_key", "_bits"), F.col("_blocks")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    group = ["_band", "_value", "_row", "_column"]
    placed = other.select("_band", "_value", F.least("_own", "_other").alias("_row"), F.greatest("_own", "_other").alias("_column"), "_own", "_key", "_bits")
    # a number of partitions that is asked for stays: the work grows with the square of what is shuffled
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        at, row, column = (held.column(c)[0].as_py() for c in ("_band", "_row", "_column"))
        there = held.column("_own").to_numpy()
        keys, all_bits = held.column("_key").combine_chunks(), held.column("_bits").to_numpy().astype(np.int64).view(np.uint64)
        if width <= 32:
            all_bits = all_bits.astype(np.uint32)
        left, right = np.flatnonzero(there == row), np.flatnonzero(there == column)
        step = max(1, HAMMING_CELLS // max(1, len(right)))
        for i in range(0, len(left), step):
            some = left[i : i + step]
            # within one block, each two rows meet once
            rest = right[i:] if row == column else right
            apart = np.bitwise_count(all_bits[some, None] ^ all_bits[None, rest])
            x, y = np.nonzero(apart <= most)
            if row == column:
                x, y = x[y > x], y[y > x]
            differs = all_bits[some[x]] ^ all_bits[rest[y]]
            first = np.ones(len(x), bool)
            for mask in masks[:at]:
                first &= (differs & differs.dtype.type(mask)) != 0
            x, y = x[first], y[first]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some[x])), keys.take(pa.array(rest[y])), pa.array(apart[x, y].astype(np.int32))], ["_p", "_q", "distance"])

    found = placed.repartition(parts, *group).groupBy(*group).applyInArrow(near, f"_p {kind}, _q {kind}, distance int")
    return found.filter("_p <> _q").select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), "distance")


def nearest_in_time(left: DataFrame, right: DataFrame, *, key: str, at: str, value: str) -> DataFrame:
    """left with the value of right's row nearest in time for the same key, the earlier one of two equally near: as-of in both directions.

    Both sides lie in one ordered sequence, so the last value before and the first behind are
    window functions, and no pairs are made. At one time, right's rows stand before left's.
    """
    names = left.columns
    a = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[at].dataType).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.groupBy(key, at).agg(F.min(value).alias(value)).select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(at).alias("_t"), F.col(value).alias("_v"))
    found = F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    # rows of left that share a time are told apart by a hash, so that the order has no ties but between equal rows
    both = Ordered.of(a.unionByName(b).withColumn("_same", F.xxhash64("_row")), ["_key"], ["_at", "_side", "_same"])
    placed = both.carried(found, "_before").carried(found, "_behind", back=True).done().filter("_side = 1")
    earlier = F.col("_behind").isNull() | (F.col("_before").isNotNull() & (F.col("_at") - F.col("_before.t") <= F.col("_behind.t") - F.col("_at")))
    pick = F.when(earlier, F.col("_before")).otherwise(F.col("_behind"))
    return placed.select("_row", pick.alias("_p")).select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("_p.t").alias("near_at"), F.col("_p.v").alias("near_value"))


def first_match(left: DataFrame, right: DataFrame, *, key: str, rules: Sequence[tuple[Mapping[str, str], Column | None]], value: str, order: str) -> DataFrame:
    """left with the value of the partner of equal key that meets the earliest rule (those that meet none come last), then by order; null without partner.

    A rule says which column of left equals which one of right, and what must hold of right
    beside. For each rule right is reduced to one partner for each combination of key and
    columns, so no join makes pairs: every row of left meets one row of each rule.
    """
    out = left
    for i, (rule, holds) in enumerate([*rules, ({}, None)]):
        best = (right if holds is None else right.filter(holds)).dropna(subset=[key, *rule.values()]).groupBy(key, *rule.values()).agg(F.min_by(value, order).alias(f"_v{i}"))
        best = best.withColumnsRenamed({key: f"_k{i}"} | {there: f"_c{i}_{n}" for n, there in enumerate(rule.values())})
        same = F.col(key) == F.col(f"_k{i}")
        for n, here in enumerate(rule):
            same = same & (F.col(here) == F.col(f"_c{i}_{n}"))
        out = out.join(best, same, "left").drop(f"_k{i}", *[f"_c{i}_{n}" for n in range(len(rule))])
    found = [F.col(f"_v{i}") for i in range(len(rules) + 1)]
    met = F.coalesce(*[F.when(v.isNotNull(), i) for i, v in enumerate(found)])
    return out.select(*left.columns, F.coalesce(*found).alias(value), met.alias("rule"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of each group with their version number from 1."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("version") <= most)


def mutual_best(pairs: DataFrame, a: str, b: str, away: str) -> DataFrame:
    """The pairs of which each side is the other's nearest; ties to the smaller partner."""
    of_a = pairs.groupBy(a).agg(F.min(F.struct(away, b))[b].alias(b))
    of_b = pairs.groupBy(b).agg(F.min(F.struct(away, a))[a].alias(a))
    return of_a.join(of_b, [a, b]).select(a, b)
