"""Nearest bit patterns, without comparing all of them one by one.

Patterns are cut into bands. Two patterns that differ in d bits differ in at most d // bands
bits of one band at least, so whoever looks up every band with 0, then 1, then 2 bits
flipped has after the round of s met all patterns within ``bands * (s + 1) - 1`` bits. A
pattern whose best distance lies within that is done; the others go on. Each band is about as
wide as the logarithm of the largest group, so that a look-up meets few patterns. A look-up
goes through a join, which costs as much as ``LOOKUP`` comparisons; where a round would cost
more than comparing all, a group's open patterns are compared with all of it, block by block:
a task holds two blocks, however large the group is. What is flipped is a table, not part of
the plan, so neither plans nor the driver grow with the rounds. Tables of patterns are joined
by sorting: written, they look small enough to be broadcast, but take thirty times as much
memory in the driver. What is broadcast has a row for each group or flip.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.sources.scratch import written

WIDTH = 64
#: Patterns of a group that are compared at once: looking up would not be less work.
SMALL = 256
#: Comparisons that take as long as looking up one pattern, or meeting one that way.
LOOKUP = 200
#: Pairs that one value of a band may bring about in one task.
MOST_MET = 10_000_000
#: Patterns of a block, and comparisons of a block that are held at once.
BLOCK, CELLS = 16_384, 1 << 19


def bands_of(largest: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """From which bit to which each band goes."""
    n = max(1, round(width / max(4, min(24, log2(max(2, largest))))))
    cuts = [width * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def band(bits: Column, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(bits, cut[0]).bitwiseAND(F.lit((1 << (cut[1] - cut[0])) - 1))


def numbered_bands(bits: Column, cuts: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("band"), band(bits, c).alias("value")) for i, c in enumerate(cuts)])


def flips(spark: SparkSession, cuts: list[tuple[int, int]], s: int) -> DataFrame:
    """band, flip: all numbers of each band's width with s bits set."""
    widths = [b - a for a, b in cuts]
    numbers = spark.range(1 << max(widths)).filter(F.bit_count("id") == s)
    own = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(1 << w).alias("_end")) for i, w in enumerate(widths)])
    return numbers.select("id", F.inline(own)).filter("id < _end").select("band", F.col("id").alias("flip"))


def by_sorting(patterns: DataFrame) -> DataFrame:
    """A table that grows with the patterns is never broadcast, however small it is thought to be."""
    return patterns.hint("merge")


def compared(left: DataFrame, right: DataFrame, sizes: DataFrame, *, within: str) -> DataFrame:
    """within, bits, _new (distance, to), _n: each pattern of left against all of its group in right, in pairs of blocks.

    right: within, _bits, _to; sizes: within, _size (patterns of right).
    """
    kind, group = right.schema["_to"].dataType, right.schema[within].dataType
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    asks = left.groupBy(within).agg(F.count(F.lit(1)).alias("_asks"))
    counts = asks.join(sizes.select(within, "_size"), within).select(within, blocks("_asks").alias("_rows"), blocks("_size").alias("_columns"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = left.select(within, "bits").join(counts, within).withColumn("_row", own("bits", "_rows")).withColumn("_column", every("_columns"))
    there = right.join(counts, within).withColumn("_column", own("_bits", "_columns")).withColumn("_row", every("_rows"))
    # a number of partitions that is asked for stays: the work grows with the square of what is shuffled
    n, key = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [within, "_row", "_column"]
    here, there = (df.select(*key, *names).repartition(n, *key).groupBy(*key) for df, names in ((here, ["bits"]), (there, ["_bits", "_to"])))

    def nearest_in_block(a: pa.Table, b: pa.Table) -> pa.Table:
        # of equal distances the first counts, that of the least ``to``
        b = b.sort_by("_to")
        asked, held = (t.column(c).to_numpy().astype(np.int64).view(np.uint64) for t, c in ((a, "bits"), (b, "_bits")))
        at, least = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int32)
        step = max(1, CELLS // max(1, len(held)))
        for i in range(0, len(asked) if len(held) else 0, step):
            apart = np.bitwise_count(asked[i : i + step, None] ^ held[None, :])
            at[i : i + step] = apart.argmin(axis=1)
            least[i : i + step] = apart[np.arange(len(apart)), at[i : i + step]]
        if not len(held):
            a = a.slice(0, 0)
            at, least = at[:0], least[:0]
        met = np.full(len(a), len(b), np.int64)
        return pa.table({within: a.column(within), "bits": a.column("bits"), "distance": pa.array(least), "to": b.column("_to").take(pa.array(at)), "_met": pa.array(met)})

    schema = f"`{within}` {group.simpleString()}, bits long, distance int, to {kind.simpleString()}, _met long"
    best = here.cogroup(there).applyInArrow(nearest_in_block, schema)
    return best.groupBy(within, "bits").agg(F.min(F.struct("distance", "to")).alias("_new"), F.sum("_met").alias("_n"))


def nearest_patterns(left: DataFrame, right: DataFrame, *, within: str) -> DataFrame:
    """within, bits, distance, to, compared: for each pattern of left the nearest of right in its group, ties to the smaller ``to``.

    left: within, bits (distinct); right: within, bits, to (distinct patterns). Groups that
    right lacks give no row. ``compared`` counts the patterns that were met on the way.
    """
    spark = left.sparkSession
    there = written(right.select(within, F.col("bits").alias("_bits"), F.col("to").alias("_to")), "patterns")
    sizes = there.groupBy(within).agg(F.count(F.lit(1)).alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    cuts = bands_of(largest)
    posted = there.select(within, F.inline(numbered_bands(F.col("_bits"), cuts)), "_bits", "_to")
    near = F.min(F.struct(F.bit_count(F.col("bits").bitwiseXOR(F.col("_bits"))).alias("distance"), F.col("_to").alias("to"))).alias("_new")
    nothing = F.lit(None).cast(f"struct<distance:int,to:{right.schema['to'].dataType.simpleString()}>")
    open_ = written(left.join(sizes, within).withColumn("_best", nothing).withColumn("compared", F.lit(0).cast("long")), "patterns")
    done, s = [], 0
    while not open_.isEmpty():
        probes = flips(spark, cuts, s).count() if s < max(b - a for a, b in cuts) else largest
        found, few = None, F.lit(True)
        if max(probes * LOOKUP, SMALL) < largest:
            asked = open_.select(within, "bits", F.inline(numbered_bands(F.col("bits"), cuts))).join(F.broadcast(flips(spark, cuts, s)), "band").withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
            key = [within, "band", "value"]
            # what looking up would meet, before anything is met
            hits = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("_a")).join(by_sorting(posted.groupBy(*key).agg(F.count(F.lit(1)).alias("_p"))), key)
            hits = hits.groupBy(within).agg(F.sum(F.col("_a") * F.col("_p")).alias("_pairs"), F.max(F.col("_a") * F.col("_p")).alias("_most"))
            costs = open_.groupBy(within).agg(F.count(F.lit(1)).alias("_asks"), F.first("_size").alias("_of")).join(hits, within, "left").na.fill(0, ["_pairs", "_most"])
            dear = (F.col("_of") <= SMALL) | ((F.col("_pairs") + F.col("_asks") * probes) * LOOKUP >= F.col("_asks") * F.col("_of")) | (F.col("_most") > MOST_MET)
            open_ = written(open_.join(costs.select(within, dear.alias("_few")), within), "patterns")
            few = F.col("_few")
            met = asked.join(by_sorting(open_.filter(~few).select(within, "bits")), [within, "bits"], "left_semi").join(by_sorting(posted), key)
            found = met.groupBy(within, "bits").agg(near, F.count(F.lit(1)).alias("_n"))
        whole = compared(open_.filter(few), there, sizes, within=within)
        found = whole if found is None else whole.unionByName(found)
        best = F.least(F.col("_best"), F.col("_new"))
        after = open_.join(by_sorting(found), [within, "bits"], "left").withColumn("_best", best).withColumn("compared", F.col("compared") + F.coalesce("_n", F.lit(0)))
        proved = few | F.coalesce(F.col("_best.distance") <= len(cuts) * (s + 1) - 1, F.lit(False))
        after = written(after.withColumn("_proved", proved).drop("_new", "_n", "_few"), "patterns")
        done.append(after.filter("_proved"))
        open_, s = after.filter(~F.col("_proved")).drop("_proved"), s + 1
    found = [d.select(within, "bits", F.col("_best.distance").alias("distance"), F.col("_best.to").alias("to"), "compared") for d in done]
    if not found:
        found = [open_.select(within, "bits", F.col("_best.distance").alias("distance"), F.col("_best.to").alias("to"), "compared")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest(left: DataFrame, right: DataFrame, *, key: str, bits: str, within: str) -> DataFrame:
    """key, distance, nearest: for each row of left the nearest pattern of right within its group, ties to the smaller key. Equal patterns are looked up once."""
    there = right.filter(F.col(bits).isNotNull()).groupBy(within, F.col(bits).alias("bits")).agg(F.min(key).alias("to"))
    here = left.filter(F.col(bits).isNotNull())
    found = nearest_patterns(here.select(within, F.col(bits).alias("bits")).distinct(), there, within=within)
    rows = here.select(F.col(key).alias("_key"), F.col(within).alias("_within"), F.col(bits).alias("_own"))
    return rows.join(by_sorting(found), (F.col("_within") == F.col(within)) & (F.col("_own") == F.col("bits"))).select(F.col("_key").alias(key), "distance", F.col("to").alias("nearest"))


def diagnostics(pairs: DataFrame, *, within: str, clock: str, near_clock: str, steps: dict[str, float], least: tuple[int, ...] = (0, 2, 4)) -> DataFrame:
    """Per group of nearest pairs: how many, how many within so many bits, the median distance, and how many within so much time.

    The median comes from a histogram of at most 65 distances, not from sorted rows.
    """
    apart = F.abs(F.col(clock) - F.col(near_clock))
    counts = [F.count_if(F.col("distance") <= d).alias(f"within_{d}_bits") for d in least] + [F.count_if(apart <= t).alias(name) for name, t in steps.items()]
    whole = pairs.groupBy(within).agg(F.count(F.lit(1)).alias("n"), *counts)
    bars = pairs.groupBy(within, "distance").agg(F.count(F.lit(1)).alias("c"))
    listed = bars.groupBy(within).agg(F.array_sort(F.collect_list(F.struct("distance", "c"))).alias("bars"))
    up_to = F.transform("bars", lambda b, i: F.struct(b["distance"].alias("distance"), F.aggregate(F.slice("bars", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["c"]).alias("upto")))
    at = lambda place: F.get(F.filter("upto", lambda b: b["upto"] > place), F.lit(0))["distance"]
    both = whole.join(listed.withColumn("upto", up_to).drop("bars"), within)
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return both.withColumn("median_bits", middle.cast("double")).drop("upto")
