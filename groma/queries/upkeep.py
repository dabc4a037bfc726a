"""Upkeep: cleaned and re-counted data sets, settings, states of jobs, bindings, sinks, made-up data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groma.catalogue import query
from groma.operators import paging, projections, rebuild, records, series
from groma.plans import settings
from groma.queries.plans import PHASES, PLAN, phases, plan
from groma.sources import datasets, generated, ledger
from groma.sources.scratch import shared_folder
from groma.sources.views import table


@query("q160_quality_clean", "WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49), kept AS (SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad) AND NOT (l_returnflag = 'R' AND l_discount = 0)) SELECT l_returnflag, count(*) AS objects, count(DISTINCT l_orderkey) AS records FROM kept GROUP BY 1")
def quality_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records go for one fault, single objects for another; the rest is counted anew."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    kept = records.without_parents(lines, lines.filter("l_quantity >= 49"), "l_orderkey").filter("NOT (l_returnflag = 'R' AND l_discount = 0)")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("l_orderkey").alias("records"))


@query("q161_review_deletions", "SELECT o_orderpriority AS kind, count(*) FILTER (o_orderkey % 7 = 0) AS gone, count(*) FILTER (o_orderkey % 7 <> 0) AS kept FROM orders GROUP BY 1")
def review_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries whose previews a reviewer has deleted."""
    manifest = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"))
    previews = manifest.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.lit(True).alias("there"))
    joined = manifest.join(previews, "o_orderkey", "left")
    return joined.groupBy("kind").agg(F.count_if(F.col("there").isNull()).alias("gone"), F.count("there").alias("kept"))


@query("q162_setting_revisions", "WITH m AS (SELECT event_id, user_id, e, c, e IS DISTINCT FROM lag(e) OVER w OR lag(event_id) OVER w IS NULL AS reset, c IS DISTINCT FROM lag(c) OVER w OR e IS DISTINCT FROM lag(e) OVER w OR lag(event_id) OVER w IS NULL AS changed FROM (SELECT event_id, user_id, event_id // 2500 AS e, event_id % 2 AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), p AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM m) SELECT event_id, reset, changed, CAST(sum(changed::INT) OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS BIGINT) AS revision FROM p")
def setting_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    requests = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(k / 2500).alias("model"), (k % 2).alias("content"))
    return settings.revisions(requests, scope="user_id", order="event_id", content="content", model="model").select("event_id", "reset", "changed", "revision")


@query("q163_analysis_states", "WITH c AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS total, count(*) FILTER (l_returnflag <> 'N') AS assessed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN total = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'empty' ELSE 'waiting' END WHEN assessed >= total THEN CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'running' END WHEN assessed > 0 THEN 'partial' ELSE 'waiting' END AS state FROM c) SELECT o_orderkey, state, state IN ('complete', 'partial', 'running') AS ready FROM s")
def analysis_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") != "N").alias("assessed"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(counts, "o_orderkey", "left").fillna(0, ["total", "assessed"])
    status = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    state = settings.analysis_state(status, F.col("total"), F.col("assessed"))
    return jobs.select("o_orderkey", state.alias("state"), settings.results_ready(state).alias("ready"))


@query("q164_snapshot_payloads", f"""WITH {PLAN} SELECT plan_id, sha256('{{"works":[' || string_agg('{{"id":' || work_id || ',"code":"' || code || '","status":"' || status || '"}}', ',' ORDER BY work_id) || ']}}') AS digest, count(*) AS works FROM plan GROUP BY plan_id""")
def snapshot_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analysis keeps of its plan, in a canonical form, and its digest."""
    work = F.struct(F.col("work_id").alias("id"), "code", "status")
    held = plan(spark, sf_dir).groupBy("plan_id").agg(F.array_sort(F.collect_list(work)).alias("works"))
    return held.select("plan_id", F.sha2(F.to_json(F.struct("works")).cast("binary"), 256).alias("digest"), F.size("works").cast("long").alias("works"))


@query("q165_demo_states", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'no data' WHEN c_custkey % 4 = 1 THEN 'behind' WHEN c_custkey % 4 = 2 THEN CASE WHEN c_custkey % 3 = 1 THEN 'check' ELSE 'on plan' END ELSE 'on plan' END AS state FROM customer")
def demo_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mode = F.when(k % 3 == 0, "offline").when(k % 3 == 1, "strict").otherwise("plain")
    scenario = F.when(k % 4 == 1, "shortage").when(k % 4 == 2, "surplus").otherwise("even")
    return table(spark, sf_dir, "customer").select("c_custkey", settings.demo_state(mode, scenario).alias("state"))


MADE = "made AS (SELECT s_suppkey * 12 + i AS id, 'source-' || s_suppkey AS run_id, CAST(i * 60 AS DOUBLE) AS clock, (s_suppkey * 7 + i * 3) % 5 AS raw_count, (s_suppkey + i) % 11 <> 0 AS usable FROM supplier, range(0, 12) AS b(i))"


@query("q166_generated_observations", f"WITH {MADE} SELECT * FROM made")
def generated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.observations(table(spark, sf_dir, "supplier"), number="s_suppkey", samples=12, step=60)


@query(
    "q199_generated_evaluation",
    f"""WITH {MADE}, g AS (SELECT *, CASE WHEN usable THEN raw_count END AS count, NOT usable OR NOT lag(usable) OVER w AS cut FROM made WINDOW w AS (PARTITION BY run_id ORDER BY clock, id)),
s AS (SELECT *, CAST(sum(CASE WHEN cut AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clock, id) AS BIGINT) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY clock, id) AS n FROM g)),
t AS (SELECT *, lead(clock) OVER (PARTITION BY run_id, segment ORDER BY clock, id) AS next FROM s)
SELECT run_id, count(DISTINCT segment) AS segments, sum(CASE WHEN next IS NULL THEN 0 ELSE least(next - clock, 60) END) AS seconds, count(*) FILTER (count < 2) AS low, count(*) FILTER (count IS NULL) AS unknown FROM t GROUP BY run_id""",
)
def generated_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up observations go through the same evaluation as real ones: segments, durations, levels against a need."""
    rows = series.durations(series.segments(generated_observations(spark, sf_dir), max_gap=120.0), step=60.0)
    count = F.when(F.col("usable"), F.col("raw_count"))
    return rows.groupBy("run_id").agg(F.count_distinct("segment").alias("segments"), F.sum(F.col("span").cast("double")).alias("seconds"), F.count_if(count < 2).alias("low"), F.count_if(count.isNull()).alias("unknown"))


@query("q167_examples", "SELECT p_type, p_partkey FROM part WHERE p_size % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 12")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve pictures of each class, of those whose licence allows it."""
    free = table(spark, sf_dir, "part").filter("p_size % 4 <> 0")
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return free.withColumn("place", place).filter("place <= 12").select("p_type", "p_partkey")


@query("q168_audit_log", "SELECT o_orderkey AS id, 'order' AS subject, o_orderstatus AS action FROM orders UNION ALL SELECT c_custkey, 'customer', c_mktsegment FROM customer")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log: two writers add to one folder, and the log is what is there."""
    path = f"{shared_folder(spark)}/groma-audit-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("subject"), F.col("o_orderstatus").alias("action")).write.mode("append").parquet(path)
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("subject"), F.col("c_mktsegment").alias("action")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("q169_partitioned_sink", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set written by class and read again: only the class that is asked for is read."""
    path = f"{shared_folder(spark)}/groma-classes-{uuid.uuid4().hex}"
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    return spark.read.parquet(path).filter("l_returnflag = 'R'")


@query("q170_binding_edits", "SELECT c_custkey, array_to_string(list_sort(list_distinct([c_custkey % 5, c_custkey % 7, 9])), ',') AS bound, array_to_string(list_sort(list_filter(list_distinct([c_custkey % 5, c_custkey % 7]), lambda x: x <> 2)), ',') AS unbound FROM customer")
def binding_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_distinct(F.array(F.col("c_custkey") % 5, F.col("c_custkey") % 7))
    listed = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    one = lambda n: F.array(F.lit(n).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", listed(settings.bound(ids, one(9))).alias("bound"), listed(settings.unbound(ids, one(2))).alias("unbound"))


@query("q171_bound_works", f"WITH {PHASES}, b AS (SELECT DISTINCT l_suppkey, l_orderkey AS work_id FROM lineitem WHERE l_quantity > 45), j AS (SELECT l_suppkey, p.work_id, phase, starts FROM b JOIN phases p USING (work_id)) SELECT l_suppkey, phase, count(*) AS works, arg_min(work_id, (starts, work_id)) AS first_work FROM j GROUP BY l_suppkey, phase")
def bound_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that a camera is bound to, by phase, with the one that is shown first."""
    bound = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_suppkey", F.col("l_orderkey").alias("work_id")).distinct()
    joined = bound.join(phases(spark, sf_dir).select("work_id", "phase", "starts"), "work_id")
    return joined.groupBy("l_suppkey", "phase").agg(F.count(F.lit(1)).alias("works"), F.min_by("work_id", F.struct("starts", "work_id")).alias("first_work"))


@query("q172_report_start", f"WITH {PLAN} SELECT plan_id, min(starts) AS report_from FROM plan WHERE status <> 'completed' GROUP BY plan_id")
def report_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).filter("status <> 'completed'").groupBy("plan_id").agg(F.min("starts").alias("report_from"))


@query("q183_played_batches", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'")
def played_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, kept by a stream in a versioned table; every batch is played twice and counts once."""
    root = f"{shared_folder(spark)}/groma-ledger-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    last = orders.agg(F.max("o_orderkey")).first()[0] or 0
    for i in range(4):
        part = orders.filter((F.col("o_orderkey") > last * i / 4) & (F.col("o_orderkey") <= last * (i + 1) / 4))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    kept = ledger.Versions(spark, f"{root}/table")
    change = lambda before, rows: ledger.upserted(before, rows, keys=["o_custkey"], order=[F.col("o_orderkey")], deleted=F.col("o_orderstatus") == "P")
    take = ledger.applied(kept, "orders", change)

    def twice(rows: DataFrame, batch: int) -> None:
        take(rows, batch)
        take(rows, batch)

    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.read().select("o_custkey", "o_orderkey", "o_orderstatus")


@query("q184_committed_set", "SELECT l_linestatus AS split, 'supplier-' || l_suppkey AS name, count(*) AS lines, CAST(sum(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS BIGINT) AS class_sum, CAST(sum(l_linenumber) AS BIGINT) AS number_sum FROM lineitem GROUP BY ALL")
def committed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of each supplier, written as a data set that appears whole, and read again."""
    path = f"{shared_folder(spark)}/groma-set-{uuid.uuid4().hex}"
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("split"), F.concat(F.lit("supplier-"), "l_suppkey").alias("name"), F.concat_ws(" ", kind, "l_linenumber", "l_quantity").alias("line"))
    datasets.publish(lines.groupBy("split", "name").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("content")), path)
    cells = F.split("line", " ")
    read = datasets.label_rows(spark, path).select("split", "name", cells[0].cast("long").alias("kind"), cells[1].cast("long").alias("number"))
    return read.groupBy("split", "name").agg(F.count(F.lit(1)).alias("lines"), F.sum("kind").alias("class_sum"), F.sum("number").alias("number_sum"))


@query(
    "q195_rebuilt_set",
    """WITH b AS (SELECT o_custkey AS grp, o_orderkey AS record, count(l_orderkey) AS boxes, count(*) FILTER (l_returnflag IN ('A', 'R')) AS kept, coalesce(sum(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 11 END), 0) AS classes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY boxes DESC, record) AS place FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY record) AS version FROM c WHERE place <= 2 AND kept > 0)
SELECT 'set__' || grp || '__v' || version AS name, record, CAST(version AS INTEGER) AS version, CAST(kept AS INTEGER) AS boxes, CAST(classes AS BIGINT) AS classes FROM k""",
)
def rebuilt_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as versions of a picture: the two with the most boxes, with their classes renamed."""
    one = F.struct(F.col("l_returnflag").alias("kind"), *[(F.col("l_linenumber") / n).alias(c) for c, n in (("x", 10), ("y", 11), ("w", 12), ("h", 13))])
    boxes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(one).alias("boxes"))
    records = table(spark, sf_dir, "orders").join(boxes, "o_orderkey", "left").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("group"), F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)).alias("boxes"))
    found = rebuild.rebuilt(records, mapping={"A": 3, "R": 11}, prefix="set", best=[F.desc(F.size("boxes"))])
    return found.select("name", "record", "version", F.size("boxes").alias("boxes"), F.aggregate("boxes", F.lit(0).cast("long"), lambda s, b: s + b["class_id"]).alias("classes"))


@query("q196_public_sources", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN '/sources/' || c_custkey || '/preview' END AS preview_url, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 1 + c_custkey % 4 END AS connection_attempt, c_acctbal IS NOT NULL AS has_balance FROM customer")
def public_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources: keys and balances are secret, what they tell is not."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.struct(F.lit("token").alias("token"), "c_mktsegment").alias("job"), F.array(F.struct(k.alias("file_key"), F.lit(1).alias("n"))).alias("files"))
    kind = F.when(F.col("job.c_mktsegment") == "BUILDING", "rtsp").otherwise("video")
    links = projections.source_links(url="/sources/%s/preview", key=k, has_preview=k % 3 == 0, kind=kind, job_status=F.when(k % 2 == 0, "queued"), lease_until=F.lit(None).cast("timestamp"), attempt=(1 + k % 4))
    shown = projections.public(rows, ["c_acctbal", "job.token", "files.file_key"], {**links, "has_balance": F.col("c_acctbal").isNotNull()})
    return shown.select("c_custkey", "c_name", "preview_url", "connection_attempt", "has_balance")


@query("q197_bounded_scan", "SELECT event_id, user_id, n > 40 AS truncated FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE place <= 40")
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.bounded_scan(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), group="user_id", order=["ts", "event_id"], most=40).drop("ts")
