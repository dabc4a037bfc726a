"""Plans: versions, imports, presets, bindings, phases, and the catalogue that they are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.catalogue import query
from groma.operators import paging
from groma.plans import versions
from groma.sources.views import table

NOW = "1998-06-01"
PLAN = """plan AS (SELECT o_orderkey AS work_id, o_custkey AS plan_id, CAST(o_orderdate AS DATE) AS starts, CAST(o_orderdate AS DATE) + 40 AS ends,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'planned' END AS status, o_orderpriority AS title, CAST(o_orderkey % 9 AS VARCHAR) AS code FROM orders)"""
PHASES = f"""{PLAN}, phases AS (SELECT *, CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'in_progress' THEN 'active' WHEN DATE '{NOW}' < starts THEN 'upcoming' WHEN DATE '{NOW}' < ends THEN 'active' ELSE 'overdue' END AS phase FROM plan)"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("planned")
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("plan_id"), day.alias("starts"), F.date_add(day, 40).alias("ends"), status.alias("status"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 9).cast("string").alias("code"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("date")
    return plan(spark, sf_dir).withColumn("phase", versions.phase(F.col("status"), F.col("starts"), F.col("ends"), now))


@query("q60_publish", "WITH v AS (SELECT o_custkey AS plan_id, count(*) AS current FROM orders GROUP BY 1) SELECT c_custkey AS plan_id, 1 + c_custkey % 20 AS base, coalesce(current, 0) AS current, CASE WHEN 1 + c_custkey % 20 = coalesce(current, 0) THEN 'published' ELSE 'conflict' END AS outcome, CASE WHEN 1 + c_custkey % 20 = coalesce(current, 0) THEN current + 1 END AS version FROM customer LEFT JOIN v ON plan_id = c_custkey")
def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    made = plan(spark, sf_dir).select("plan_id", F.row_number().over(Window.partitionBy("plan_id").orderBy("work_id")).cast("long").alias("version"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan_id"), (1 + F.col("c_custkey") % 20).alias("base"))
    return versions.published(requests, made)


@query("q61_early_start", "SELECT o_orderkey, CASE WHEN CAST(begun + INTERVAL 3 HOUR AS DATE) < CAST(o_orderdate + INTERVAL 3 HOUR AS DATE) THEN begun ELSE o_orderdate END AS starts FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 HOUR * (o_orderkey % 60) AS begun FROM orders)")
def early_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = F.col("o_orderdate").cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(planned) + 3_600_000_000 * (24 - F.col("o_orderkey") % 60))
    return table(spark, sf_dir, "orders").select("o_orderkey", versions.started_early(planned, at, "+03:00").cast("timestamp_ntz").alias("starts"))


@query("q62_resource_preset", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '1:0,7:0,9:3' ELSE '1:' || (p_size % 4) || ',7:' || (p_size % 3 + p_partkey % 2) || ',9:3' END AS resources FROM part")
def resource_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(F.lit("1"), (F.col("p_size") % 4).cast("int"), F.lit("7"), (F.col("p_size") % 3).cast("int"), F.lit("15"), (F.col("p_partkey") % 2).cast("int"), F.lit("9"), F.lit(1))
    made = versions.preset(raw, aliases={"15": "7"}, zeroed=F.col("p_size") % 5 == 0, overrides={"9": 3})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(made), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("resources"))


@query("q63_import_ids", f"WITH {PLAN}, c AS (SELECT plan_id, code, min(work_id) AS w FROM plan GROUP BY ALL), t AS (SELECT plan_id, title, min(work_id) AS w FROM plan GROUP BY ALL HAVING count(*) = 1), r AS (SELECT l_orderkey AS row, l_linenumber AS line, l_suppkey, l_partkey % 1500 AS plan_id, CAST(l_linenumber + 5 AS VARCHAR) AS code, CASE l_linenumber % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS title FROM lineitem) SELECT row, line, l_suppkey, plan_id, code, title, coalesce(c.w, t.w) AS work_id, CASE WHEN c.w IS NOT NULL THEN 'code' WHEN t.w IS NOT NULL THEN 'title' ELSE 'new' END AS matched FROM r LEFT JOIN c USING (plan_id, code) LEFT JOIN t USING (plan_id, title)")
def import_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("l_linenumber") % 3 == 0, "1-URGENT").when(F.col("l_linenumber") % 3 == 1, "2-HIGH").otherwise("5-LOW")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("line"), "l_suppkey", (F.col("l_partkey") % 1500).alias("plan_id"), (F.col("l_linenumber") + 5).cast("string").alias("code"), title.alias("title"))
    return versions.identified(rows, plan(spark, sf_dir))


@query("q64_catalogue_bridge", "SELECT p_type, count(*) AS works, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS codes FROM part WHERE p_size < 20 GROUP BY p_type")
def catalogue_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of each project type, in the order of their codes."""
    pairs = table(spark, sf_dir, "part").filter("p_size < 20").groupBy("p_type").agg(F.count(F.lit(1)).alias("works"), F.array_sort(F.collect_list(F.struct("p_size", "p_partkey"))).alias("all"))
    return pairs.select("p_type", "works", F.array_join(F.transform("all", lambda x: x["p_partkey"].cast("string")), ",").alias("codes"))


@query("q65_work_state_map", f"WITH {PLAN} SELECT plan_id, string_agg(work_id || '=' || status, ';' ORDER BY work_id) AS states FROM plan GROUP BY plan_id")
def work_state_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = plan(spark, sf_dir).groupBy("plan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("work_id", "status")))).alias("m"))
    return held.select("plan_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ";").alias("states"))


@query("q66_work_phases", f"WITH {PHASES} SELECT plan_id, phase, count(*) AS works, count(*) FILTER (status <> 'completed' AND ends <= DATE '{NOW}') AS overdue, min(starts) AS first_start FROM phases GROUP BY plan_id, phase")
def work_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("status") != "completed") & (F.col("ends") <= F.lit(NOW).cast("date"))
    return phases(spark, sf_dir).groupBy("plan_id", "phase").agg(F.count(F.lit(1)).alias("works"), F.count_if(late).alias("overdue"), F.min("starts").alias("first_start"))


@query("q67_default_work", f"WITH {PHASES} SELECT plan_id, arg_min(work_id, (CASE WHEN phase = 'active' THEN 0 ELSE 1 END, CASE WHEN status <> 'completed' THEN 0 ELSE 1 END, work_id)) AS work_id FROM phases GROUP BY plan_id")
def default_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.first_by(phases(spark, sf_dir), ["plan_id"], [F.col("phase") == "active", F.col("status") != "completed"], "work_id")


@query("q68_rebound_regions", """WITH r AS (SELECT l_suppkey AS source_id, l_linenumber AS region_id, list_sort(list(DISTINCT l_partkey % 40)) AS ids FROM lineitem WHERE l_quantity < 8 GROUP BY ALL),
w AS (SELECT s_suppkey AS source_id, list_sort(list_distinct([s_suppkey % 40, s_suppkey * 7 % 40, s_suppkey * 11 % 40])) AS plan_works FROM supplier),
k AS (SELECT source_id, region_id, list_sort(list_intersect(ids, plan_works)) AS ids FROM r JOIN w USING (source_id)), kept AS (SELECT * FROM k WHERE len(ids) > 0),
b AS (SELECT source_id, flatten(list(ids)) AS bound FROM kept GROUP BY 1), f AS (SELECT source_id, list_sort(list_filter(plan_works, lambda x: NOT coalesce(list_contains(bound, x), false))) AS ids FROM w LEFT JOIN b USING (source_id))
SELECT source_id, region_id, array_to_string(ids, ',') AS work_ids FROM kept UNION ALL SELECT source_id, NULL, array_to_string(ids, ',') FROM f WHERE len(ids) > 0""")
def rebound_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity < 8")
    regions = lines.groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("region_id")).agg(F.collect_set(F.col("l_partkey") % 40).alias("work_ids"))
    k = F.col("s_suppkey")
    works = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.array_distinct(F.array(k % 40, k * 7 % 40, k * 11 % 40)).alias("plan_works"))
    return versions.rebound(regions, works).withColumn("work_ids", F.array_join(F.transform(F.array_sort("work_ids"), lambda x: x.cast("string")), ","))


@query("q69_context_changed", "SELECT o_orderkey, coalesce(NULLIF(o_orderkey % 4, 0), 2) <> coalesce(NULLIF(o_custkey % 3, 0), 2) OR coalesce(NULLIF(o_orderpriority, '5-LOW'), '1-URGENT') <> '1-URGENT' AS changed FROM orders")
def context_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {"gap": F.nullif(F.col("o_orderkey") % 4, F.lit(0)), "mode": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))}
    after = {"gap": F.nullif(F.col("o_custkey") % 3, F.lit(0)), "mode": F.lit(None).cast("string")}
    return table(spark, sf_dir, "orders").select("o_orderkey", versions.changed_context(before, after, {"gap": F.lit(2).cast("long"), "mode": F.lit("1-URGENT")}).alias("changed"))


@query("q70_recent", "SELECT o_orderkey, o_orderdate, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)


@query("q71_offset_page", "SELECT p_partkey, p_name, CASE WHEN n > 50 THEN 170 END AS next_offset FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_name, p_partkey) AS k FROM (SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 51 OFFSET 120)) WHERE k <= 50")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.offset_page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], size=50, offset=120)


@query("q72_listed_order", "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1")
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", paging.listed_place(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]))


@query("q73_processing_phase", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'analysing' WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_custkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'probing' ELSE 'new' END AS phase FROM orders")
def processing_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    ladder = F.when((s == "F") & (k % 3 == 0), "failed").when(s == "F", "ready").when((s == "P") & (k % 2 == 0), "analysing").when(s == "P", "queued").when((F.col("o_custkey") % 2 == 0) & (k % 5 == 0), "probing")
    return table(spark, sf_dir, "orders").select("o_orderkey", ladder.otherwise("new").alias("phase"))


@query("q74_class_lists", "SELECT c_custkey, array_to_string(list_sort(list_distinct([c_custkey % 5, c_nationkey % 7, 3])), ',') AS planning, array_to_string(list_sort(list_filter(list_distinct([c_nationkey % 7, 3]), lambda x: x <> c_custkey % 5)), ',') AS additional FROM customer")
def class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, listed = F.array(F.col("c_custkey") % 5), F.array((F.col("c_nationkey") % 7).cast("long"), F.lit(3).cast("long"))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "customer").select("c_custkey", text(F.array_union(own, listed)).alias("planning"), text(F.array_except(listed, own)).alias("additional"))


@query("q75_row_json", """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}' AS payload, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}') AS digest FROM orders""")
def row_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))


@query("q76_plan_template", "SELECT o_custkey, o_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN count(*) FILTER (l_returnflag = 'A') ELSE 0 END AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, strftime(any_value(o_orderdate) + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S+03:00') AS starts_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def plan_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan as it is exported: a column for each class, local times."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    counts = lines.groupBy("o_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    local = F.date_format(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "+03:00"), "yyyy-MM-dd'T'HH:mm:ss'+03:00'")
    joined = table(spark, sf_dir, "orders").join(counts, "o_orderkey")
    return joined.select("o_custkey", "o_orderkey", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in ("A", "N", "R")], local.alias("starts_at"))


@query("q77_loop_lengths", "SELECT o_orderkey, CASE WHEN least(o_totalprice, greatest(o_custkey % 3, o_orderkey % 5) * 1000.0::DOUBLE) >= 1 THEN least(o_totalprice, greatest(o_custkey % 3, o_orderkey % 5) * 1000.0::DOUBLE) END AS seconds FROM orders")
def loop_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed recording lasts as long as asked for, at most as long as its longest work, and a second at least."""
    longest = F.greatest(F.col("o_custkey") % 3, F.col("o_orderkey") % 5) * 1000.0
    seconds = F.least("o_totalprice", longest)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(seconds >= 1, seconds).alias("seconds"))


@query("q78_plan_faults", f"WITH {PLAN}, m AS (SELECT *, count(*) OVER (PARTITION BY plan_id, code) > 1 AS again FROM plan) SELECT work_id, concat_ws(',', CASE WHEN again THEN 'repeated' END, CASE WHEN NOT starts < ends - CAST(work_id % 41 AS INTEGER) THEN 'period' END, CASE WHEN work_id % 6 = 0 THEN 'classes' END) AS errors FROM m")
def plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groma.plans import cascade

    resources = F.when(F.col("work_id") % 6 == 0, F.create_map(F.lit("A"), F.lit(1))).otherwise(F.create_map(F.lit("N"), F.lit(1), F.lit("A"), F.lit(2)))
    works = plan(spark, sf_dir).withColumn("ends", F.date_sub("ends", (F.col("work_id") % 41).cast("int"))).withColumn("resources", resources)
    return cascade.faults(works, plan="plan_id", work="code", starts="starts", ends="ends", classes=["A", "N"], resources="resources").select("work_id", F.array_join("errors", ",").alias("errors"))
