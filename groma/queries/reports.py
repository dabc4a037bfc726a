"""Reports with the data's own classes, measures of pictures, maps, splits by need, names from hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.catalogue import query
from groma.functions import maps, pictures, text
from groma.operators import hamming, reports, splits
from groma.queries.records import BITS, patterns
from groma.sources import sheets
from groma.sources.scratch import shared_folder
from groma.sources.views import table

#: Plain names in place of the report's own thirteen, as SQL columns.
HEADS = ("project", "report_from", "report_to", "code", "title", "work_from", "work_to", "begun", "resolved", "last_seen", "notified", "source", "message")
PICTURE = "pic AS (SELECT vec_id, [x::DOUBLE * 100 for x in embedding[:64]] AS g FROM embeddings WHERE len(embedding) >= 64)"


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, g: vectors as pictures of 8 x 8."""
    found = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 64)
    return found.select("vec_id", F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double") * 100).alias("g"))


@query(
    "q185_picture_measures",
    f"""WITH {PICTURE} SELECT vec_id, round(list_avg(g), 4) AS brightness, round(sqrt(list_avg([(x - list_avg(g)) * (x - list_avg(g)) for x in g])), 4) AS contrast,
  round((list_avg([abs(g[i + 8] - g[i]) for i in range(1, 57)]) + list_avg([abs(g[i + 1] - g[i]) for i in range(1, 65) if i % 8 <> 0])) / 2, 4) AS edge_energy FROM pic""",
)
def picture_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("g")
    return grey(spark, sf_dir).select("vec_id", F.round(pictures.brightness(g), 4).alias("brightness"), F.round(pictures.contrast(g), 4).alias("contrast"), F.round(pictures.edge_energy(g, 8, 8), 4).alias("edge_energy"))


@query(
    "q186_cosine_hash",
    f"""WITH {PICTURE}, w AS (SELECT [[sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 8.0) * cos(pi() * (2 * n + 1) * k / 16.0) for n in range(0, 8)] for k in range(0, 4)] AS c),
a AS (SELECT vec_id, [[list_sum([g[8 * y + n] * row[n] for n in range(1, 9)]) for y in range(0, 8)] for row in c] AS columns, c FROM pic, w),
b AS (SELECT vec_id, flatten([[list_sum([col[n] * row[n] for n in range(1, 9)]) for col in columns] for row in c]) AS block FROM a),
m AS (SELECT vec_id, block, median(x) AS middle FROM (SELECT vec_id, block, unnest(block[5:]) AS x FROM b) GROUP BY ALL)
SELECT vec_id, CAST(list_sum([CASE WHEN block[i] > middle THEN (1::BIGINT << (16 - i)) ELSE 0 END for i in range(1, 17)]) AS BIGINT) AS hash FROM m""",
)
def cosine_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perceptual hash of the lowest 4 x 4 frequencies."""
    return grey(spark, sf_dir).select("vec_id", pictures.cosine_hash(F.col("g"), 8, 4).alias("hash"))


@query(
    "q187_event_report",
    """WITH a AS (SELECT o_orderkey, o_custkey % 30 AS source_id, o_orderkey % 50 AS work_id, o_orderstatus, o_orderdate::TIMESTAMP AS t FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' AND o_orderkey % 11 <> 0),
c AS (SELECT l_orderkey, sum(l_linenumber) FILTER (l_returnflag = 'A') AS a, sum(l_linenumber) FILTER (l_returnflag = 'N') AS n, sum(l_linenumber) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT 'site' AS project, '01.01.1992 00:00:00' AS report_from, '' AS report_to, CASE WHEN o_orderkey % 3 = 0 THEN '9.' || o_orderkey % 5 ELSE CASE WHEN work_id < 40 THEN work_id || '.1' ELSE '' END END AS code,
  CASE WHEN work_id < 40 THEN CASE WHEN work_id % 4 = 0 THEN '''=stage ' ELSE 'stage ' END || work_id ELSE '' END AS title, '' AS work_from, '' AS work_to, strftime(t, '%d.%m.%Y %H:%M:%S') AS begun,
  CASE WHEN o_orderstatus = 'F' THEN strftime(t + INTERVAL 90 MINUTE, '%d.%m.%Y %H:%M:%S') ELSE '' END AS resolved, strftime(t + INTERVAL 90 MINUTE, '%d.%m.%Y %H:%M:%S') AS last_seen, '' AS notified,
  CASE WHEN source_id < 25 THEN 'camera ' || source_id ELSE '' END AS source, 'too few' AS message, CAST(o_orderkey % 4 AS VARCHAR) AS "arm: план", coalesce(CAST(a AS VARCHAR), '') AS "arm: на кадре",
  '' AS "Класс N: план", coalesce(CAST(n AS VARCHAR), '') AS "Класс N: на кадре", '2' AS "Класс R: план", coalesce(CAST(r AS VARCHAR), '') AS "Класс R: на кадре"
FROM a LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the classes that they were expected to have and had: two columns for each class that occurs."""
    k = F.col("o_orderkey")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.sum("l_linenumber").alias("n"))
    counts = counts.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("counts"))
    begun = F.col("o_orderdate").cast("timestamp")
    none = F.lit(None)
    alerts = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").select(
        k.alias("id"), (F.col("o_custkey") % 30).alias("source_id"), (k % 50).alias("work_id"), F.lit(1).alias("plan_id"), F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("unknown").alias("status"),
        begun.alias("first_seen"), F.timestamp_micros(F.unix_micros(begun) + 5_400_000_000).alias("last_seen"), F.when(k % 7 != 0, "too few").alias("message"), F.when(k % 3 == 0, F.concat(F.lit("9."), (k % 5).cast("string"))).alias("code"), none.cast("string").alias("title"),
        *[none.cast("timestamp").alias(c) for c in ("work_starts_at", "work_ends_at", "notified_at")], F.create_map(F.lit("A"), k % 4, F.lit("R"), F.lit(2).cast("long")).alias("expected"), "counts", F.lit(False).alias("suppressed"), F.when(k % 11 == 0, False).alias("confirmed"),
    )
    work = F.col("o_orderkey")
    works = table(spark, sf_dir, "orders").filter("o_orderkey < 40").select(F.lit(1).alias("plan_id"), work.alias("work_id"), F.concat(work.cast("string"), F.lit(".1")).alias("code"), F.concat(F.when(work % 4 == 0, "=stage ").otherwise("stage "), work.cast("string")).alias("title"), none.cast("timestamp").alias("starts_at"), none.cast("timestamp").alias("ends_at"))
    sources = spark.range(25).select(F.col("id").alias("source_id"), F.concat(F.lit("camera "), F.col("id").cast("string")).alias("name"))
    return reports.event_rows(alerts, works=works, sources=sources, project="site", begins=F.lit("1992-01-01").cast("timestamp"), ends=none.cast("timestamp"), zone="UTC", names={"A": "arm"}, columns=HEADS)


@query(
    "q188_plan_table",
    """WITH r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT o_orderkey % 90 || '.' || o_orderkey AS code, 'work ' || o_orderkey AS title, strftime(o_orderdate::TIMESTAMP + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00' AS begins, strftime(o_orderdate::TIMESTAMP + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00' AS ends,
  coalesce(a, 0) AS arm, coalesce(n, 0) AS n, coalesce(r, 0) AS r, 0::BIGINT AS crane FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""",
)
def plan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of now (A and 17) and those that works still have."""
    k = F.col("o_orderkey")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("resources"))
    at = F.col("o_orderdate").cast("timestamp")
    works = table(spark, sf_dir, "orders").join(held, "o_orderkey", "left").select(F.concat_ws(".", (k % 90).cast("string"), k.cast("string")).alias("code"), F.concat(F.lit("work "), k.cast("string")).alias("title"), at.alias("starts_at"), F.timestamp_micros(F.unix_micros(at) + 6 * 3_600_000_000).alias("ends_at"), "resources")
    found = reports.plan_table(works, current=["A", "17"], names={"A": "arm", "N": "n", "R": "r", "17": "crane"}, zone="+03:00", columns=("code", "title", "begins", "ends"))
    return found.withColumn("crane", F.col("crane").cast("long"))


@query(
    "q189_map_changes",
    """WITH m AS (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT)::VARCHAR END AS v, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS t2,
    lead(CAST(json_extract(props, '$.k') AS VARCHAR)) OVER w AS k2, lead(CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT)::VARCHAR END) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, concat_ws(',', CASE WHEN k <> k2 THEN 'k:' || k || '>' || k2 END, CASE WHEN event_type <> t2 THEN 'type:' || event_type || '>' || t2 END, CASE WHEN v2 IS NOT NULL AND v IS DISTINCT FROM v2 THEN 'v:' || coalesce(v, '-') || '>' || v2 END) AS changed,
  CASE WHEN v IS NOT NULL AND v2 IS NULL THEN 'v' ELSE '' END AS removed FROM m WHERE next_id IS NOT NULL""",
)
def map_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between an event's fields and those of the user's next event."""
    from groma.operators.ordered import Ordered

    entries = F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value")))
    more = F.when(F.col("event_id") % 5 == 0, F.array(F.struct(F.lit("v").alias("key"), F.floor("value").cast("long").cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    held = table(spark, sf_dir, "events").select("user_id", "event_id", F.map_from_entries(F.concat(entries, more)).alias("m"))
    pairs = Ordered.of(held, ["user_id"], ["event_id"]).neighbours(after={"n": F.col("m")}).done().filter("n is not null")
    spelled = F.transform(F.array_sort(F.map_entries(maps.changed_entries(F.col("m"), F.col("n")))), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"]["before"], F.lit("-")), F.lit(">"), e["value"]["after"]))
    return pairs.select("event_id", F.array_join(spelled, ",").alias("changed"), F.array_join(maps.removed_keys(F.col("m"), F.col("n")), ",").alias("removed"))


@query(
    "q190_counted_classes",
    """WITH c AS (SELECT l_orderkey AS id, l_returnflag AS class_id, sum(l_linenumber) AS found FROM lineitem GROUP BY ALL), e AS (SELECT o_orderkey AS id, o_orderkey % 2 AS even, unnest(['A', 'N', 'X']) AS class_id, unnest([o_orderkey % 9, 4, 1]) AS expected FROM orders),
z AS (SELECT id, even, class_id, expected, found FROM e LEFT JOIN c USING (id, class_id)) SELECT id, class_id, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, CAST(greatest(0, expected - found) AS BIGINT) AS missing, CAST(CASE WHEN found IS NOT NULL THEN CASE WHEN even = 0 THEN 0 ELSE greatest(0, found - expected) END END AS BIGINT) AS excess
FROM z WHERE found IS NOT NULL AND even = 1 AND expected > found""",
)
def counted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found things of alerts about missing ones, class by class."""
    k = F.col("o_orderkey")
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.sum("l_linenumber").alias("n"))
    found = found.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("counts"))
    alerts = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").join(found, "o_orderkey", "left")
    expected = F.create_map(F.lit("A"), k % 9, F.lit("N"), F.lit(4).cast("long"), F.lit("X"), F.lit(1).cast("long"))
    rows = maps.counted_classes(F.lit("missing"), expected, F.col("counts"), F.lit(None).cast("array<struct<class_id:string,count:bigint>>"))
    return alerts.select(k.alias("id"), F.explode(rows).alias("r")).select("id", "r.class_id", "r.expected", "r.found", "r.missing", "r.excess")


@query("q191_split_by_need")
def split_by_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components, with the return flags and ship modes of their line items as classes; every class in every split."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.concat("l_returnflag", F.when(F.col("l_quantity") > 48, "+").otherwise(""))
    counts = lines.groupBy(F.col("l_partkey").alias("component"), kind.alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    weights = lines.groupBy(F.col("l_partkey").alias("component")).agg(F.count(F.lit(1)).alias("weight"))
    return splits.assigned(counts.join(weights, "component"), shares=[("train", 0.75), ("val", 0.15), ("test", 0.1)])


@query(
    "q192_hamming_diagnostics",
    f"""WITH {BITS}, p AS (SELECT a.vec_id, a.vec_id % 20 AS camera, bit_count(xor(a.bits, c.bits)) AS distance, c.vec_id AS nearest FROM b a JOIN b c ON a.vec_id % 20 = c.vec_id % 20 AND a.vec_id % 3 = 0 AND c.vec_id % 3 <> 0),
n AS (SELECT camera, vec_id, min(distance) AS distance, arg_min(nearest, (distance, nearest)) AS nearest FROM p GROUP BY ALL)
SELECT camera, count(*) AS n, count(*) FILTER (distance <= 8) AS within_8_bits, count(*) FILTER (distance <= 16) AS within_16_bits, count(*) FILTER (abs(vec_id - nearest) <= 100) AS close, median(distance)::DOUBLE AS median_bits FROM n GROUP BY camera""",
)
def hamming_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near one split's patterns come to the other's, by camera."""
    rows = patterns(spark, sf_dir).withColumn("camera", F.col("vec_id") % 20)
    pairs = hamming.nearest(rows.filter("vec_id % 3 = 0"), rows.filter("vec_id % 3 <> 0"), key="vec_id", bits="bits", within="camera").withColumn("camera", F.col("vec_id") % 20)
    return hamming.diagnostics(pairs, within="camera", clock="vec_id", near_clock="nearest", steps={"close": 100}, least=(8, 16))


@query("q193_seeded_order", "SELECT p_partkey, sha1('7:' || p_partkey) AS place, CASE WHEN p_size > 40 THEN 'Сверх плана ' || p_size || ' ед. техники' ELSE 'Обнаружена техника сверх плана' END AS message, CAST(CASE WHEN p_size <= 10 THEN 60 WHEN p_size <= 30 THEN 180 ELSE 600 END AS INTEGER) AS step FROM part")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    excess = F.when(F.col("p_size") > 40, F.col("p_size"))
    steps = F.array(*[F.lit(x) for x in (60, 180, 600)])
    return table(spark, sf_dir, "part").select("p_partkey", text.seeded_order(7, F.col("p_partkey")).alias("place"), text.shown_message(F.lit("Техника сверх плана"), F.lit("excess"), excess).alias("message"), text.default_step(F.col("p_size"), steps).alias("step"))


@query(
    "q200_period_faults",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'time' WHEN o_orderkey % 3 = 0 THEN 'zone' WHEN o_orderkey % 4 >= 2 AND o_orderkey % 5 <> 0 THEN 'order' END AS fault FROM orders",
)
def period_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods as they are sent: a fifth without an end, some without a zone, some that end before they begin, some that are no times."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(k % 3 == 0, "").otherwise("+03:00")
    start = F.when(k % 11 == 0, "soon").otherwise(F.concat(iso(at), zone))
    hours = F.when(k % 4 == 2, F.expr("INTERVAL 0 HOUR")).when(k % 4 == 3, F.expr("INTERVAL -1 HOUR")).otherwise(F.expr("INTERVAL 1 HOUR"))
    end = F.when(k % 5 != 0, F.concat(iso(at + hours), zone))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.period_fault(start, end).alias("fault"))


@query(
    "q201_workbook_cells",
    "WITH s AS (SELECT CAST(1 + row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS row, * FROM supplier) SELECT row, 1 AS col, CAST(s_suppkey AS VARCHAR) AS value FROM s UNION ALL SELECT row, 2, s_name FROM s UNION ALL SELECT row, 3, CAST(s_nationkey AS VARCHAR) FROM s UNION ALL SELECT 1, unnest([1, 2, 3]), unnest(['key', 'name', 'nation'])",
)
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as a workbook and read again, cell by cell."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    path = sheets.write_workbook(rows, f"{shared_folder(spark)}/groma-book-{uuid.uuid4().hex}/report.xlsx")
    return sheets.sheet_cells(spark, path.rsplit("/", 1)[0]).select("row", "col", "value")
