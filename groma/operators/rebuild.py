"""Data sets rebuilt from archived copies: versions of a picture thinned out, classes renamed, boxes of others left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that a name may have.
NAME_CHARS, LONGEST_NAME, NAMELESS = r"[^0-9A-Za-zА-Яа-яЁё._-]+", 150, "image"


def safe_stem(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, NAME_CHARS, "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, LONGEST_NAME), F.lit("")), F.lit(NAMELESS))


def rebuilt(records: DataFrame, *, mapping: Mapping[str, int], prefix: str, most: int = 2, best: Sequence[Column] = ()) -> DataFrame:
    """name, record, group, version, boxes. records: record, group, boxes (array of kind, x, y, w, h).

    Of each group's records the first ``most`` by ``best``, then by name, are chosen; boxes of
    classes without a mapping go, and records without any box left. The others are numbered
    within their group by name. Where two names come out alike, the later one (by group and
    record) gets a digest of its record's name.
    """
    order = [*best, F.col("record")]
    chosen = records.withColumn("_place", F.row_number().over(Window.partitionBy("group").orderBy(*order))).filter(F.col("_place") <= most)
    new = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    mapped = F.transform(F.filter("boxes", lambda b: F.map_contains_key(new, b["kind"])), lambda b: F.struct(F.element_at(new, b["kind"]).alias("class_id"), *[b[c].alias(c) for c in ("x", "y", "w", "h")]))
    kept = chosen.withColumn("boxes", mapped).filter(F.size("boxes") > 0)
    versioned = kept.withColumn("version", F.row_number().over(Window.partitionBy("group").orderBy("record")))
    named = versioned.withColumn("name", safe_stem(F.concat_ws("__", F.lit(prefix), F.col("group").cast("string"), F.concat(F.lit("v"), F.col("version").cast("string")))))
    again = F.row_number().over(Window.partitionBy("name").orderBy("group", "record")) > 1
    digest = F.substring(F.sha1(F.col("record").cast("string").cast("binary")), 1, 10)
    return named.withColumn("_again", again).select(F.when(F.col("_again"), F.concat_ws("__", "name", digest)).otherwise(F.col("name")).alias("name"), "record", "group", "version", "boxes")


def as_files(found: DataFrame, split: str) -> DataFrame:
    """split, name and content, as a data set is written."""
    line = lambda b: F.concat_ws(" ", b["class_id"].cast("string"), *[F.format_string("%.6f", b[c].cast("double")) for c in ("x", "y", "w", "h")])
    return found.select(F.lit(split).alias("split"), "name", F.concat(F.array_join(F.transform("boxes", line), "\n"), F.lit("\n")).alias("content"))


def counted(records: DataFrame, found: DataFrame, mapping: Mapping[str, int]) -> DataFrame:
    """kind, class_id, source_objects, images, objects: what the source held of each class, and what is left of it; class_id is null where all went."""
    source = records.select(F.explode("boxes.kind").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("source_objects"))
    left = found.select("record", F.explode("boxes.class_id").alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("record").alias("images"))
    new = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return source.withColumn("class_id", F.try_element_at(new, F.col("kind"))).join(left, "class_id", "left").select("kind", "class_id", "source_objects", zero("images"), zero("objects"))
