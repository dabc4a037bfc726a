"""Mixing sources to target weights.

Words are summed per source, a water level turns weights into targets (none above ``cap``
times its source), and a document is emitted floor(rate) times, plus once more if a number
hashed from its id and the seed lies below the rate's fraction.

Defined results: a null text has size 0; null sources form a source of their own, ranked
last; rows that share an id share their draw; an empty table gives an empty result; input
columns named like the operator's own (``COLUMNS``) are replaced by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groma.sources.scratch import ordered_parts, parts_before

from .common import count_words, scratch, table, without

COLUMNS = ["size", "source_size", "target", "rate", "copies", "taken"]
#: A rates table of at most this many rows (some 60 bytes each) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 50_000


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size -> source, source_size, target; one row per source.

    With the sources in the order of cap * size / weight, those below the water level are
    full; the level is the first one that its own source can hold. There may be as many
    sources as hosts, so they are laid out by ranges, and what lies before a row is the sum
    of the ranges before plus that of its own range.
    """
    one = sizes.select("source", "source_size", F.lit(0).alias("all"), F.col("source").isNull().alias("last"))
    named = ordered_parts(one, ["last", "source"], "sources")
    by_name = Window.partitionBy("part").orderBy("last", "source")
    ranked = named.join(parts_before(named, "all", F.count(F.lit(1))), ["all", "part"]).withColumn("rank", F.col("before") + F.row_number().over(by_name)).drop("part", "before", "total", "last")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.get(pattern, ((F.col("rank") - 1) % len(weights)).cast("int")))
    full = weighed.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    placed = ordered_parts(full, ["ratio", "rank"], "ratios")
    of = lambda c, name: parts_before(placed, "all", F.sum(c)).withColumnsRenamed({"before": f"{name}_before", "total": f"{name}_total"})
    joined = placed
    for c in ("source_size", "most", "weight"):
        joined = joined.join(of(c, c), ["all", "part"])
    own = Window.partitionBy("part").orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(own), F.lit(0.0))
    level = (F.col("source_size_total") * F.lit(float(share)) - earlier("most")) / (F.col("weight_total") - earlier("weight"))
    levels = scratch(joined.withColumn("level", level).select("source", "source_size", "rank", "weight", "most", "ratio", "level"), "levels")
    water = levels.filter("ratio >= level").agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("water")).first()["water"]
    target = F.col("most") if water is None else F.least(F.lit(float(water)) * F.col("weight"), F.col("most"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken. share: total of the targets as a share of all words."""
    held = without(docs, COLUMNS)
    # the input's columns stay inside one struct: no name of theirs can clash
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in held.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("own"), count_words(F.col(text)).alias("size"))
    sizes = sized.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"))
    table_of_rates = rates(sizes, weights, share, cap)
    small = table_of_rates.count() <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(table_of_rates) if small else table_of_rates, F.col("own").eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    more = (draw(F.col("id"), seed) < F.col("rate") - whole).cast("long")
    taken = joined.withColumn("rate", rate).withColumn("copies", whole + more).withColumn("taken", F.col("copies") * F.col("size"))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in held.columns], *COLUMNS)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns it came with."""
    names = without(mixed, COLUMNS).columns
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    taken = mixed.filter("copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), times.alias("copy"))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sized GROUP BY source),
full_at AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM ranked),
levels AS (
  SELECT *, most / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM full_at WINDOW before AS (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT level AS water FROM levels WHERE ratio >= level ORDER BY ratio, rnk LIMIT 1),
targets AS (
  SELECT source, source_size, least(coalesce((SELECT water FROM water) * weight, most), most) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
