"""Frames against the plan, versions of plans, tracks of boxes, and what becomes of raw detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.catalogue import DETECTIONS, WORKS, ZONES, _crossings, query
from groma.functions import geometry
from groma.operators import boxes, frames
from groma.sources import views
from groma.sources.views import table
from groma.streaming import tracks

#: Zones that works are bound to, and whether they can be seen.
REGIONS = {"ramp": (ZONES["ramp"], True), "yard": (ZONES["yard"], False), "gate": ([(0.0, 0.0), (0.6, 0.0), (0.6, 0.7), (0.0, 0.7)], True)}


def site(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as works and plans, their line items as frames with detections."""
    lines = views.detections(spark, sf_dir)
    works = views.works(spark, sf_dir)
    days = lines.groupBy("frame_id").agg(F.min("day").alias("at"))
    plans = works.select(F.col("work_id").alias("frame_id"), "plan_id")
    supported = F.when(F.col("frame_id") % 5 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(*[F.lit(c) for c in views.CLASSES]))
    n = F.col("row") % 100
    activity = F.when(n % 3 == 0, "idle").when(n % 3 == 1, "working").otherwise("unknown")
    needs = F.explode(F.array(*[F.struct(F.lit(c).alias("class_id"), F.lit(k).alias("of")) for c, k in zip(views.CLASSES, (3, 4, 2), strict=True)])).alias("c")
    zones = [(name, [{"x": x, "y": y} for x, y in points], seen) for name, (points, seen) in REGIONS.items()]
    bound = F.array(F.when(F.col("work_id") % 2 == 0, "ramp"), F.when(F.col("work_id") % 3 == 0, "yard"), F.when(F.col("work_id") % 5 != 0, "gate"))
    return {
        "frames": days.join(plans, "frame_id").select("frame_id", "plan_id", "at", (F.col("frame_id") % 7 != 0).alias("usable"), supported.alias("supported")),
        "detections": lines.select("frame_id", "class_id", "box", activity.alias("activity"), (n % 4 != 0).alias("observed")),
        "works": works.select("plan_id", "work_id", "starts", "ends", (F.col("status") == "F").alias("done")),
        "resources": works.select("work_id", needs).select("work_id", "c.class_id", (F.col("work_id") % F.col("c.of")).alias("need")),
        "regions": spark.createDataFrame(zones, "region_id string, polygon array<struct<x:double,y:double>>, visible boolean"),
        "bindings": works.select("work_id", F.explode(F.array_compact(bound)).alias("region_id")),
    }


SITE = f"""{DETECTIONS}, {WORKS},
frames AS (SELECT frame_id, w.plan_id, first_day, frame_id % 7 <> 0 AS usable FROM (SELECT frame_id, min(day) AS first_day FROM det GROUP BY 1) d JOIN works w ON w.work_id = d.frame_id),
bindings AS (SELECT work_id, region_id FROM works, (VALUES ('ramp', true), ('yard', false), ('gate', true)) AS r(region_id, visible)
  WHERE CASE region_id WHEN 'ramp' THEN work_id % 2 = 0 WHEN 'yard' THEN work_id % 3 = 0 ELSE work_id % 5 <> 0 END),
local AS (SELECT frame_id, region_id, class_id, count(*) AS n, count(*) FILTER (row % 100 % 3 = 0 AND row % 100 % 4 <> 0) AS n_idle
  FROM det, (VALUES ('ramp'), ('yard'), ('gate')) AS r(region_id)
  WHERE CASE region_id WHEN 'ramp' THEN {_crossings(REGIONS["ramp"][0])} WHEN 'yard' THEN {_crossings(REGIONS["yard"][0])} ELSE {_crossings(REGIONS["gate"][0])} END GROUP BY ALL),
assigned AS (SELECT f.frame_id, b.region_id, w.work_id, usable, b.region_id <> 'yard' AS visible FROM frames f JOIN works w ON f.plan_id = w.plan_id AND f.first_day >= w.starts AND f.first_day < w.ends AND w.status <> 'F' JOIN bindings b ON b.work_id = w.work_id),
counted AS (SELECT a.*, c.class_id, a.work_id % c.of_ AS need, l.n, CASE WHEN usable AND visible AND (c.class_id <> 'R' OR a.frame_id % 5 <> 0) THEN coalesce(l.n, 0) END AS count
  FROM assigned a CROSS JOIN (VALUES ('A', 3), ('N', 4), ('R', 2)) AS c(class_id, of_) LEFT JOIN local l ON l.frame_id = a.frame_id AND l.region_id = a.region_id AND l.class_id = c.class_id),
judged AS (SELECT *, EXISTS (SELECT 1 FROM counted o WHERE o.frame_id = c.frame_id AND o.class_id = c.class_id AND o.work_id <> c.work_id AND o.need > 0 AND o.n > 0) AS explained FROM counted c)"""


@query(
    "q50_frame_findings",
    f"""WITH {SITE}, totals AS (SELECT frame_id, region_id, work_id, any_value(usable) AND any_value(visible) AS seen, sum(CASE WHEN count IS NOT NULL THEN greatest(0, need - count) ELSE 0 END) AS short, sum(need) AS needed,
  bool_and(need <= 0 OR count IS NOT NULL) AS complete, sum(CASE WHEN count > need AND NOT explained THEN count - need ELSE 0 END) AS excess FROM judged GROUP BY frame_id, region_id, work_id)
SELECT frame_id, region_id, work_id, CASE WHEN complete AND seen THEN 'ready' ELSE 'insufficient_evidence' END AS readiness, CAST(CASE WHEN complete THEN short END AS BIGINT) AS missing, CAST(needed AS BIGINT) AS needed,
  CASE WHEN complete THEN round(coalesce(short / nullif(needed, 0)::DOUBLE, 0), 6) END AS missing_ratio, CAST(excess AS BIGINT) AS excess,
  CASE WHEN seen THEN CAST(coalesce((SELECT sum(n_idle) FROM local l WHERE l.frame_id = t.frame_id AND l.region_id = t.region_id), 0) AS BIGINT) END AS n_idle,
  CASE WHEN seen THEN coalesce((SELECT string_agg(class_id || ':' || n_idle, ',' ORDER BY class_id) FROM local l WHERE l.frame_id = t.frame_id AND l.region_id = t.region_id AND n_idle > 0), '') END AS idle FROM totals t""",
)
def frame_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.evaluate(**site(spark, sf_dir), width=30)
    listed = F.array_join(F.transform("idle", lambda x: F.concat_ws(":", x["class_id"], x["count"].cast("string"))), ",")
    return found.withColumn("missing_ratio", F.round("missing_ratio", 6)).withColumn("excess", F.col("excess").cast("long")).withColumn("idle", listed)


@query("q51_plan_snapshot", "WITH v AS (SELECT o_custkey AS plan_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_totalprice FROM orders) SELECT event_id AS run_id, CAST(user_id AS BIGINT) AS plan_id, CAST(1 + event_id % 12 AS INTEGER) AS version, o_totalprice AS budget FROM events LEFT JOIN v ON v.plan_id = user_id AND v.version = 1 + event_id % 12")
def plan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    numbered = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), numbered.alias("version"), F.col("o_totalprice").alias("budget"))
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").cast("long").alias("plan_id"), (1 + F.col("event_id") % 12).cast("int").alias("version"))
    return frames.snapshot(runs, versions).select("run_id", "plan_id", "version", "budget")


@query("q48_tracker")
def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier as detections of a run, one frame a day."""
    lines = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") / 100, F.col("l_discount") * 5
    seen = lines.select(F.col("l_suppkey").alias("run_id"), F.unix_date(F.to_date("l_shipdate")).cast("double").alias("clock"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row"), F.col("l_returnflag").alias("class_id"), (F.col("l_linenumber") / 8).alias("score"), x.alias("x1"), y.alias("y1"), (x + 0.2).alias("x2"), (y + 0.3).alias("y2"))
    return tracks.tracks(seen)


@query("q52_letterbox", f"WITH {DETECTIONS}, p AS (SELECT row, x1 * 640 AS a, y1 * 640 AS b, x2 * 640 AS c, y2 * 640 AS d FROM det) SELECT row, round(greatest(0, least(1, a / 640)), 6) AS x1, round(greatest(0, least(1, (b - 140) / 360)), 6) AS y1, round(greatest(0, least(1, c / 640)), 6) AS x2, round(greatest(0, least(1, (d - 140) / 360)), 6) AS y2 FROM p WHERE least(1, (d - 140) / 360) > greatest(0, (b - 140) / 360)")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform(F.array(*[F.col(f"box.{k}") for k in ("x1", "y1", "x2", "y2")]), lambda v: v * 640)
    found = views.detections(spark, sf_dir).select("row", boxes.unletterboxed(pixels, width=1920, height=1080, side=640).alias("box")).filter("box is not null")
    return found.select("row", *[F.round(f"box.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("q53_best_class", "SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, round(greatest(l_discount * 10, l_tax * 12, l_quantity / 50), 6) AS score, CASE WHEN l_discount * 10 >= greatest(l_tax * 12, l_quantity / 50) THEN 'digger' WHEN l_tax * 12 >= l_quantity / 50 THEN 'crane' ELSE 'truck' END AS class_id FROM lineitem WHERE greatest(l_discount * 10, l_tax * 12, l_quantity / 50) >= 0.35")
def best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50)
    rows = table(spark, sf_dir, "lineitem").withColumn("best", boxes.best_class(scores, ["digger", "crane", "truck"], least=0.35)).filter("best is not null")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.round("best.score", 6).alias("score"), "best.class_id")


@query("q54_top_detections", f"WITH {DETECTIONS} SELECT frame_id, row, score FROM (SELECT frame_id, row, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, row) AS n FROM det) WHERE n <= 3")
def top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.strongest(views.detections(spark, sf_dir), frame="frame_id", score="score", row="row", most=3)


@query("q55_frame_quality", "SELECT vec_id, round(m, 6) AS brightness, round(s, 6) AS sharpness, m > 12 AND m < 248 AND s > 2 AS usable FROM (SELECT vec_id, 128 + 400 * list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m, 20 * (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) AS s FROM embeddings WHERE len(embedding) > 0)")
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0).select("vec_id", (128 + 400 * mean).alias("m"), (20 * (F.array_max(v) - F.array_min(v))).alias("s"))
    return rows.select("vec_id", F.round("m", 6).alias("brightness"), F.round("s", 6).alias("sharpness"), boxes.usable(F.col("m"), F.col("s")).alias("usable"))


@query("q56_centre_boxes", "WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, greatest(0, l_quantity * 8 - 60) AS x1, l_discount * 4000 AS y1, least(300, l_quantity * 8 + 60) AS x2, least(240, l_discount * 4000 + 90) AS y2 FROM lineitem) SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, round((x1 + x2) / 600, 6) AS x, round((y1 + y2) / 480, 6) AS y, round((x2 - x1) / 300, 6) AS w, round((y2 - y1) / 240, 6) AS h FROM p WHERE x2 > x1 AND y2 > y1")
def centre_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = boxes.centred(F.col("l_quantity") * 8 - 60, F.col("l_discount") * 4000, F.lit(120.0), F.lit(90.0), width=300, height=240)
    rows = table(spark, sf_dir, "lineitem").withColumn("b", made).filter("b is not null")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", *[F.round(f"b.{k}", 6).alias(k) for k in ("x", "y", "w", "h")])


@query("q57_tiles", "SELECT o_orderkey, CAST(least(x * 480, greatest(w - 640, 0)) AS INTEGER) AS x1, CAST(least(y * 480, greatest(h - 640, 0)) AS INTEGER) AS y1, CAST(least(least(x * 480, greatest(w - 640, 0)) + 640, w) AS INTEGER) AS x2, CAST(least(least(y * 480, greatest(h - 640, 0)) + 640, h) AS INTEGER) AS y2 FROM (SELECT o_orderkey, 300 + o_orderkey % 1700 AS w, 200 + o_orderkey % 1300 AS h FROM orders), range(0, 4) AS a(x), range(0, 4) AS b(y) WHERE (x = 0 OR (x - 1) * 480 + 640 < w) AND (y = 0 OR (y - 1) * 480 + 640 < h)")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "orders").select("o_orderkey", (300 + F.col("o_orderkey") % 1700).alias("w"), (200 + F.col("o_orderkey") % 1300).alias("h"))
    return sized.select("o_orderkey", F.explode(boxes.tiles(F.col("w"), F.col("h"), side=640, step=480)).alias("t")).select("o_orderkey", *[F.col(f"t.{k}").cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")])


SEAMS = f"""WITH RECURSIVE {DETECTIONS}, n AS (SELECT frame_id, class_id, row, score, row % 4 AS tile, row % 3 <> 0 AS at_edge, x1, y1, x2, y2, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, row) AS i FROM det),
f AS (SELECT DISTINCT frame_id, class_id, 0::BIGINT AS i, CAST([] AS STRUCT(row BIGINT, score DOUBLE, tile BIGINT, at_edge BOOLEAN, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, parts INTEGER)[]) AS kept FROM n
UNION ALL SELECT frame_id, class_id, i, CASE WHEN hit IS NULL THEN list_append(kept, x) ELSE [CASE WHEN j = hit THEN {{'row': kept[j].row, 'score': kept[j].score, 'tile': kept[j].tile, 'at_edge': kept[j].at_edge, 'x1': least(kept[j].x1, x.x1), 'y1': least(kept[j].y1, x.y1), 'x2': greatest(kept[j].x2, x.x2), 'y2': greatest(kept[j].y2, x.y2), 'parts': kept[j].parts + 1}} ELSE kept[j] END for j in range(1, len(kept) + 1)] END
FROM (SELECT frame_id, class_id, i, kept, x, list_position([k.at_edge AND x.at_edge AND k.tile <> x.tile AND greatest(0, least(k.x2, x.x2) - greatest(k.x1, x.x1)) * greatest(0, least(k.y2, x.y2) - greatest(k.y1, x.y1)) / nullif(least((k.x2 - k.x1) * (k.y2 - k.y1), (x.x2 - x.x1) * (x.y2 - x.y1)), 0) >= 0.55 for k in kept], true) AS hit
  FROM (SELECT n.frame_id, n.class_id, n.i, f.kept, {{'row': n.row, 'score': n.score, 'tile': n.tile, 'at_edge': n.at_edge, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2, 'parts': 1::INTEGER}} AS x FROM f JOIN n ON n.frame_id = f.frame_id AND n.class_id = f.class_id AND n.i = f.i + 1))),
last AS (SELECT frame_id, class_id, arg_max(kept, i) AS kept FROM f GROUP BY ALL)
SELECT frame_id, class_id, k.row, k.score, round(k.x1, 6) AS x1, round(k.y1, 6) AS y1, round(k.x2, 6) AS x2, round(k.y2, 6) AS y2, k.parts FROM (SELECT frame_id, class_id, unnest(kept) AS k FROM last)"""


@query("q58_seam_merge", SEAMS)
def seam_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that tiles' edges may have cut, merged over the seams."""
    found = views.detections(spark, sf_dir).withColumn("tile", F.col("row") % 4).withColumn("at_edge", F.col("row") % 3 != 0)
    merged = boxes.merged_over_seams(found, frame="frame_id", kind="class_id", box="box", score="score", row="row", tile="tile", at_edge="at_edge", least=0.55)
    return merged.select("frame_id", "class_id", "row", "score", *[F.round(f"box.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")], "parts")


@query("q59_region_areas", "SELECT o_orderkey, round(abs(2 * a * b) / 2, 6) AS area, abs(2 * a * b) / 2 >= 1e-4 AS valid FROM (SELECT o_orderkey, (o_orderkey % 100) / 1000.0::DOUBLE AS a, (o_orderkey % 7) / 97.0::DOUBLE AS b FROM orders)")
def region_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("o_orderkey") % 100) / 1000.0, (F.col("o_orderkey") % 7) / 97.0
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    half = F.array(corner(F.lit(0.5) + a, F.lit(0.5)), corner(F.lit(0.5), F.lit(0.5) + b), corner(F.lit(0.5) - a, F.lit(0.5)))
    area = geometry.polygon_area(half)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(area, 6).alias("area"), (area >= 1e-4).alias("valid"))


@query("q179_activity")
def machine_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier as machines on a camera, one frame a day, with made-up measurements of the pictures."""
    from groma.streaming import activity

    n = F.col("l_orderkey") + F.col("l_linenumber")
    x = 0.02 + (n % 3) * 0.3 + F.col("l_tax") / 10
    lines = table(spark, sf_dir, "lineitem").withColumn("clock", F.unix_date(F.to_date("l_shipdate")).cast("double"))
    day = F.col("clock")
    # what holds for a whole frame depends on its run and day alone
    changed = F.when(day % 31 == 0, 0.05).when(day % 37 == 0, 0.5).otherwise(0.001)
    grid = lambda c: F.array(*[c.cast("double")] * 4)
    seen = lines.select(
        F.col("l_suppkey").alias("run_id"), "clock", (day % 2 == 0).alias("detects"), (F.col("l_suppkey") % 50 != 0).alias("usable"), F.lit(320).alias("width"), F.lit(320).alias("height"),
        F.when(day % 41 == 0, 5.0).otherwise(0.0).alias("scene_shift"), F.lit(1.0).alias("response"), F.lit(2).alias("grid_width"), grid(changed).alias("changed"), grid(F.lit(120.0)).alias("brightness"), grid(F.lit(20.0)).alias("spread"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row"), F.col("l_returnflag").alias("class_id"), (0.3 + F.col("l_linenumber") / 10).alias("score"),
        x.alias("x1"), F.lit(0.2).alias("y1"), (x + 0.2).alias("x2"), F.lit(0.7).alias("y2"), F.lit(None).cast("array<double>").alias("appearance"),
    )
    return activity.activity(seen, sample=1.0, max_interframe=20.0, groups={"A": "mobile", "R": "stationary_capable"}, idle_after=20.0)
