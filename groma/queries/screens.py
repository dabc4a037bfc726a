"""Scalar functions and small derivations: texts, files, boxes that move, sets, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groma.catalogue import DETECTIONS, query
from groma.functions import geometry, text
from groma.operators import boxes, joins, paging
from groma.sources import files, images, views
from groma.sources.views import table


@query("q130_plural_labels", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 14 THEN 'рабочих' WHEN o_orderkey % 10 = 1 THEN 'рабочий' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'рабочих' ELSE 'рабочих' END AS label FROM orders")
def plural_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.plural(F.col("o_orderkey"), "рабочий", "рабочих", "рабочих").alias("label"))


@query("q131_duration_labels", "SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' WHEN s >= 60 THEN (s // 60) || ' min ' || (s % 60) || ' s' ELSE s || ' s' END AS label FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.duration_label(F.col("event_id") * 7 % 9000).alias("label"))


@query("q132_safe_names", "SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS name, lower(trim(regexp_replace('  ' || p_name || '  ', '\\s+', ' ', 'g'))) AS key FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("name"), text.search_key(padded).alias("key"))


@query("q133_addresses", "SELECT c_custkey, array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END], lambda x: x IS NOT NULL), ', ') AS address FROM (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'KAZAN' END AS b, 'n' || c_nationkey AS c FROM customer)")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise("KAZAN")
    return table(spark, sf_dir, "customer").select("c_custkey", text.distinct_parts(F.col("c_mktsegment"), second, F.lit("  "), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("address"))


@query("q134_page_texts", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages WHERE html IS NOT NULL")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", text.plain_text(F.col("html")).alias("body"))


@query("q135_file_times", "SELECT event_id, 'cam' || user_id AS camera, date_trunc('second', CAST(ts AS TIMESTAMP)) AS time FROM events WHERE event_id % 3 <> 2")
def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, camera = F.col("ts").cast("timestamp"), F.concat(F.lit("cam"), F.col("user_id").cast("string"))
    name = F.when(F.col("event_id") % 3 == 0, F.concat(camera, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".jpg")))
    name = name.when(F.col("event_id") % 3 == 1, F.concat(camera, F.lit("-"), F.date_format(at, "yyyy-MM-dd-HH-mm-ss"), F.lit(".png"))).otherwise("thumbs.db")
    rows = table(spark, sf_dir, "events").select("event_id", text.camera_and_time(name).alias("f")).filter("f is not null")
    return rows.select("event_id", "f.camera", F.col("f.time").cast("timestamp_ntz").alias("time"))


@query("q136_scene_keys", "SELECT coalesce(source, '') || '/' || doc_id // 50 AS scene, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def scene_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.scene_key(F.coalesce("source", F.lit("")), F.col("doc_id"), 50)
    return table(spark, sf_dir, "documents").groupBy(key.alias("scene")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("q137_expected_boxes", f"WITH {DETECTIONS}, v AS (SELECT row, x1, y1, least(2, row % 5) * (0.5 * (row % 3) / 100 + 0.5 * (row % 7) / 100)::DOUBLE AS dx FROM det) SELECT row, round(x1 + dx, 9) AS x1, round(y1 - dx, 9) AS y1 FROM v")
def expected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("row")
    velocity = geometry.smoothed((r % 3) / 100, (r % 7) / 100)
    box = geometry.ahead(F.col("box"), velocity, -velocity, (r % 5).cast("double"))
    return views.detections(spark, sf_dir).select("row", box.alias("b")).select("row", F.round("b.x1", 9).alias("x1"), F.round("b.y1", 9).alias("y1"))


@query("q138_appearance", "SELECT a.vec_id AS vec_id, round(list_cosine_similarity(list_transform(a.e, lambda x: x - list_avg(a.e)), list_transform(b.e, lambda x: x - list_avg(b.e))), 6) AS correlation FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) a JOIN (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(geometry.correlation(F.col("embedding"), F.col("other")), 6).alias("correlation"))


@query("q139_difference_hashes", "SELECT vec_id, bit_count(CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN 1::HUGEINT << (63 - i) ELSE 0 END)) AS BIGINT)) AS rising FROM embeddings WHERE len(embedding) = 64")
def difference_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", F.bit_count(geometry.difference_hash(F.col("embedding"))).cast("tinyint").alias("rising"))


@query("q140_over_smaller", f"WITH {DETECTIONS}, p AS (SELECT a.frame_id, a.row AS a, b.row AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS both_, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS small FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.row < b.row) SELECT frame_id, a, b, round(both_ / small, 6) AS share FROM p WHERE both_ / small >= 0.55")
def over_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.detections(spark, sf_dir).select("frame_id", "row", "box")
    x, y = found.select("frame_id", F.col("row").alias("a"), F.col("box").alias("u")), found.select("frame_id", F.col("row").alias("b"), F.col("box").alias("v"))
    pairs = x.join(y, "frame_id").filter("a < b").withColumn("share", boxes.over_smaller(F.col("u"), F.col("v")))
    return pairs.filter("share >= 0.55").select("frame_id", "a", "b", F.round("share", 6).alias("share"))


@query("q141_visible_overlay", f"WITH {DETECTIONS} SELECT frame_id, count(*) AS shown, string_agg(DISTINCT class_id, ',' ORDER BY class_id) AS classes FROM det WHERE row % 4 <> 0 AND class_id <> 'A' GROUP BY frame_id")
def visible_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn over a frame: things seen in it, of classes that are not hidden."""
    held = views.detections(spark, sf_dir).withColumn("observed", F.when(F.col("row") % 4 == 0, False))
    shown = held.filter(F.coalesce("observed", F.lit(True)) & ~F.col("class_id").isin("A"))
    return shown.groupBy("frame_id").agg(F.count(F.lit(1)).alias("shown"), F.array_join(F.array_sort(F.collect_set("class_id")), ",").alias("classes"))


@query("q142_settings_overlay", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 60 ELSE 30 END AS absence_confirm_seconds, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal / 10000 ELSE 0.5 END AS critical_missing_ratio FROM customer")
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings over the defaults; secret columns are not part of the projection."""
    k = F.col("c_custkey")
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, k % 60).alias("a"), F.when(k % 5 == 0, F.col("c_acctbal") / 10000).alias("r"), F.lit("secret").alias("token")).drop("token")
    return stored.select("c_custkey", F.coalesce("a", F.lit(30).cast("long")).alias("absence_confirm_seconds"), F.coalesce("r", F.lit(0.5)).alias("critical_missing_ratio"))


@query("q143_page_union", "SELECT o_orderkey, max(o_totalprice) AS price FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01') GROUP BY 1")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that overlap, as one list without repeats."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("d"))
    return paging.united([orders.filter("d < timestamp'1998-01-01'"), orders.filter("d > timestamp'1997-06-01'")], "o_orderkey").drop("d")


@query("q144_ordered_unique", "SELECT o_orderkey, a || CASE WHEN b <> a THEN ',' || b ELSE '' END || CASE WHEN c <> a AND c <> b THEN ',' || c ELSE '' END AS names FROM (SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) AS a, CAST(o_orderkey % 4 AS VARCHAR) AS b, CAST(o_orderkey % 2 AS VARCHAR) AS c FROM orders)")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[(F.col("o_orderkey") % n).cast("string") for n in (3, 4, 2)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_distinct(names), ",").alias("names"))


@query("q145_set_overlaps", "SELECT o_custkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS together FROM (SELECT o_custkey, list(DISTINCT o_orderkey % 7) FILTER (o_orderstatus = 'O') AS a, list(DISTINCT o_orderkey % 7) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def set_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey") % 7))
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("O").alias("a"), of("F").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return held.select("o_custkey", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("together"))


@query("q146_named_groups", "SELECT n_name, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, c_mktsegment) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things by class, the largest group first, then by the name's place in the Russian alphabet."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    counts = table(spark, sf_dir, "customer").join(nations, "c_nationkey").groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("n_name").orderBy(F.desc("n"), F.collate("c_mktsegment", "RU"))
    return counts.withColumn("place", F.row_number().over(order).cast("long"))


@query("q147_label_lines", f"WITH {DETECTIONS} SELECT frame_id, string_agg(printf('%s %.6f %.6f', class_id, (x1 + x2) / 2, (y1 + y2) / 2), chr(10) ORDER BY row, printf('%s %.6f %.6f', class_id, (x1 + x2) / 2, (y1 + y2) / 2)) AS body FROM det GROUP BY frame_id")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = files.label_line(F.col("class_id"), (F.col("box.x1") + F.col("box.x2")) / 2, (F.col("box.y1") + F.col("box.y2")) / 2)
    held = views.detections(spark, sf_dir).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("all"))
    return held.select("frame_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("body"))


@query("q148_fingerprints", "SELECT o_orderkey, sha256(o_custkey || '/' || o_orderkey || '/' || o_orderstatus) AS fingerprint FROM orders")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.fingerprint(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("fingerprint"))


@query("q149_layout", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'train' WHEN doc_id % 4 = 1 THEN 'val' WHEN doc_id % 4 = 2 THEN 'test' ELSE 'all' END AS split, CASE WHEN doc_id % 3 = 0 THEN 'label' ELSE 'image' END AS kind, 'img' || doc_id AS stem FROM documents WHERE doc_id % 11 <> 0")
def folder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    folder = F.when(k % 11 == 0, "/data/staging-1/").when(k % 4 == 0, "/data/train/").when(k % 4 == 1, "/data/valid/").when(k % 4 == 2, "/data/TEST/").otherwise("/data/")
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("img"), k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".jpg")).alias("path"))
    return images.layout(named).withColumn("doc_id", F.regexp_extract("stem", r"\d+", 0).cast("long")).select("doc_id", "split", "kind", "stem")


@query("q150_mutual_matches", f"WITH {DETECTIONS}, p AS (SELECT a.row AS a, b.row AS b, min(abs(a.x1 - b.x1) + abs(a.y1 - b.y1)) AS away FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.class_id = b.class_id AND a.split = 'F' AND b.split = 'O' GROUP BY ALL) SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY away, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY away, a) = 1")
def mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two detectors that are each other's nearest of their class and frame."""
    found = views.detections(spark, sf_dir)
    side = lambda s, n: found.filter(F.col("split") == s).select("frame_id", "class_id", F.col("row").alias(n), F.col("box.x1").alias(f"{n}x"), F.col("box.y1").alias(f"{n}y"))
    pairs = side("F", "a").join(side("O", "b"), ["frame_id", "class_id"]).withColumn("away", F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by")))
    return joins.mutual_best(pairs, "a", "b", "away")
