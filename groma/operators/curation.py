"""Curation of labelled records: duplicates, groups, splits, suppression of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groma.functions.geometry import iou
from groma.operators import graphs
from groma.sources.scratch import ordered_parts, parts_before, written


def exact_groups(df: DataFrame, *, record: str, content: Column, order: Sequence[Column] = ()) -> DataFrame:
    """record, representative (of equal content the first by ``order``, then the smallest), copies."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(record).alias("record"))
    hashed = df.filter(content.isNotNull()).select(record, F.sha2(content.cast("binary"), 256).alias("_hash"), rank.alias("_rank"))
    groups = hashed.groupBy("_hash").agg(F.min("_rank")["record"].alias("representative"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(groups, "_hash").select(record, "representative", "copies")


def components(spark: SparkSession, pairs: DataFrame, *, record: str, key: str) -> DataFrame:
    """record, component: the smallest record reachable by shared keys. Records hang on the smallest one of each key, a star for each key, never all pairs."""
    stars = pairs.join(pairs.groupBy(key).agg(F.min(record).alias("_hub")), key)
    edges = written(stars.select(F.col(record).alias("a"), F.col("_hub").alias("b")).distinct(), "component-edges")
    roots = graphs.components(edges)
    return edges.select(F.col("a").alias("node")).distinct().join(roots, "node", "left").select(F.col("node").alias(record), F.coalesce("root", "node").alias("component"))


def split_of(component: Column, shares: Sequence[tuple[str, float]]) -> Column:
    """A split for each component from a hash of its name: all records of a component go together, and growth moves none."""
    at = F.conv(F.substring(F.md5(component.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    total, out = 0.0, None
    for name, share in shares[:-1]:
        total += share
        out = F.when(at < total, name) if out is None else out.when(at < total, name)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])


def suppress(boxes: DataFrame, *, frame: str, box: str, score: str, kind: str, row: str, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression: in each frame and class, by falling score, a box goes if it overlaps a kept one by more than the threshold.

    A frame holds a bounded number of boxes (the detector's limit), so they are one array and
    the fold is an expression; frames are spread by a shuffle.
    """
    ordered = boxes.groupBy(frame, kind).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("_order"), F.col(row).alias("row"), F.col(box).alias("box")))).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    add = lambda kept, x: F.when(F.exists(kept, lambda k: iou(k["box"], x["box"]) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    kept = ordered.select(frame, kind, F.explode(F.aggregate("_all", none, add)).alias("_k"))
    return kept.select(frame, kind, F.col("_k.row").alias(row), (-F.col("_k._order")).alias(score))


def unique_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order: replays of a request keep the first answer."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def diverse_picks(frames: DataFrame, *, group: str, row: str, feature: str, most: int, look_back: int = 5) -> DataFrame:
    """group, row, place: at most ``most`` frames of each group that differ from each other, beginning with the first one.

    Each round takes the frame furthest (L1) from the nearest of the last ``look_back`` picks, ties
    to the smaller row. A round is one pass over all frames and one aggregate: a group's
    picks so far are a row that is joined to its frames, so a group of any size is many tasks.
    """
    rows = frames.select(F.col(group).alias("_group"), F.col(row).alias("_row"), F.transform(feature, lambda x: x.cast("double")).alias("_x"))
    pick = F.struct(F.col("_row").alias("row"), F.col("_x").alias("x"))
    picks = written(rows.groupBy("_group").agg(F.array(F.min_by(pick, "_row")).alias("_picks")), "picks")
    for _ in range(most - 1):
        away = lambda p: F.aggregate(F.zip_with("_x", p["x"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d)
        last = F.slice("_picks", F.greatest(F.size("_picks") - look_back + 1, F.lit(1)), F.lit(look_back))
        rest = rows.join(picks, "_group").filter(~F.exists("_picks", lambda p: p["row"] == F.col("_row")))
        far = rest.select("_group", pick.alias("_pick"), F.array_min(F.transform(last, away)).alias("_away"), "_row")
        found = far.groupBy("_group").agg(F.min_by("_pick", F.struct(-F.col("_away"), "_row")).alias("_pick"))
        added = F.when(F.col("_pick").isNotNull(), F.concat("_picks", F.array("_pick"))).otherwise(F.col("_picks"))
        picks = written(picks.join(found, "_group", "left").select("_group", added.alias("_picks")), "picks")
    placed = picks.select("_group", F.posexplode("_picks").alias("_at", "_p"))
    return placed.select(F.col("_group").alias(group), F.col("_p.row").alias(row), (F.col("_at") + 1).alias("place"))


def ranked(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """df with rank within the group. Rows are laid out by range and numbered there, behind what the ranges before hold, so a group is many tasks."""
    keyed = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    placed = ordered_parts(keyed, [group, *keys], "ranked")
    before = parts_before(placed, group, F.count(F.lit(1)))
    number = F.row_number().over(Window.partitionBy(group, "part").orderBy(*keys))
    return placed.join(before, [group, "part"]).withColumn("rank", F.col("before") + number).drop("part", "before", "total", *keys)
