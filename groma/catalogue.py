"""All queries of the site operators, with the SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.functions import geometry, text
from groma.operators import curation, episodes, joins, paging, series, statistics
from groma.operators.ordered import Ordered
from groma.plans import cascade
from groma.sources import files, views
from groma.sources.scratch import shared_folder
from groma.sources.views import table
from groma.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000
DAY = 24 * HOUR
GAP = 20 * HOUR

OBS = """obs AS (SELECT event_id AS id, user_id AS run_id, epoch_us(ts) AS clock, event_type AS class_id, event_type <> 'error' AS usable,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 END AS raw_count FROM events)"""
SEGMENTS = f"""{OBS}, stepped AS (SELECT *, clock - lag(clock) OVER w AS step, lag(usable) OVER w AS before FROM obs WINDOW w AS (PARTITION BY run_id ORDER BY clock, id)),
seg AS (SELECT id, run_id, clock, class_id, usable, raw_count, CAST(sum(CASE WHEN step > {GAP} OR step <= 0 OR (step IS NOT NULL AND NOT usable) OR NOT before THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY clock, id) AS BIGINT) AS segment FROM stepped),
spans AS (SELECT *, CASE WHEN next IS NULL THEN 0 ELSE least(next - clock, {6 * HOUR}) END AS span FROM (SELECT *, lead(clock) OVER (PARTITION BY run_id, segment ORDER BY clock, id) AS next FROM seg))"""
FINDINGS = f"""{OBS}, f AS (SELECT CAST(run_id AS VARCHAR) AS fingerprint, clock, CASE WHEN NOT usable THEN 'N' WHEN raw_count < 2 THEN 'F' ELSE 'C' END AS kind,
  coalesce((4 - raw_count) / 4.0::DOUBLE > 0.8::DOUBLE, false) AS above FROM obs)"""
EPISODES = f"""{FINDINGS}, g AS (SELECT *, lag(kind) OVER w AS before, clock - lag(clock) OVER w AS gap, lead(kind) OVER w AS next_kind, lead(clock) OVER w AS next_clock FROM f WINDOW w AS (PARTITION BY fingerprint ORDER BY clock)),
h AS (SELECT *, CAST(sum(CASE WHEN before = 'F' AND gap <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY fingerprint ORDER BY clock) AS BIGINT) AS episode FROM g WHERE kind = 'F'),
i AS (SELECT *, max(CASE WHEN NOT above THEN clock END) OVER (PARTITION BY fingerprint, episode) AS below FROM h),
e AS (SELECT fingerprint, episode, min(clock) AS first_seen, max(clock) AS stop, arg_max(coalesce(next_kind, '-'), clock) AS after, arg_max(coalesce(next_clock, 0), clock) AS after_clock, arg_max(above, clock) AS last_above,
  min(CASE WHEN below IS NULL OR clock > below THEN clock END) AS since FROM i GROUP BY ALL),
done AS (SELECT fingerprint, episode, first_seen, CASE WHEN after = 'C' THEN after_clock ELSE stop END AS last_seen, stop - first_seen AS duration,
  CASE WHEN after = 'C' THEN 'resolved' WHEN after <> '-' THEN 'interrupted' WHEN stop - first_seen >= {5 * HOUR} THEN 'open' ELSE 'unknown' END AS status,
  CASE WHEN last_above THEN stop - since ELSE 0 END AS critical_duration, CASE WHEN last_above AND stop - since >= {10 * HOUR} THEN 'critical' ELSE 'warning' END AS severity, stop - first_seen < {5 * HOUR} AS suppressed FROM e)"""
DETECTIONS = """det AS (SELECT l_orderkey AS frame_id, l_orderkey * 100 + l_linenumber AS row, l_partkey AS plan_id, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day, l_returnflag AS class_id, CAST(l_quantity AS BIGINT) AS level,
  l_extendedprice AS score, l_linestatus AS split, l_quantity / 100 AS x1, l_discount * 5 AS y1, l_quantity / 100 + 0.2::DOUBLE AS x2, l_discount * 5 + 0.1::DOUBLE + l_tax AS y2 FROM lineitem)"""
WORKS = """works AS (SELECT o_orderkey AS work_id, o_custkey AS plan_id, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS starts, CAST(o_orderdate AS DATE) - DATE '1970-01-01' + 30 AS ends, o_orderstatus AS status FROM orders)"""
MEASURED = f"""{DETECTIONS}, {WORKS}, active AS (SELECT d.row, w.work_id, d.class_id AS seen, d.level, d.split FROM det d JOIN works w ON d.plan_id = w.plan_id AND d.day >= w.starts AND d.day < w.ends AND w.status <> 'F'),
measured AS (SELECT row, work_id, c.class_id, work_id % c.need AS need, CASE WHEN seen = c.class_id THEN level % 5 WHEN split = 'O' THEN 0 END AS count
  FROM active, (VALUES ('A', 3), ('N', 4), ('R', 2)) AS c(class_id, need))"""


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, work_id, class_id, need, count: a row for each class of each work that is active at a detection, known or not."""
    open_works = views.works(spark, sf_dir).filter("status <> 'F'")
    active = joins.interval_join(views.detections(spark, sf_dir), open_works, key="plan_id", at="day", starts="starts", ends="ends", width=30)
    spine = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(n).alias("of")) for c, n in zip(views.CLASSES, (3, 4, 2), strict=True)])).alias("c")
    rows = active.select("row", "work_id", "class_id", "level", "split", spine)
    count = F.when(F.col("class_id") == F.col("c.name"), F.col("level") % 5).when(F.col("split") == "O", 0)
    return rows.select("row", "work_id", F.col("c.name").alias("class_id"), (F.col("work_id") % F.col("c.of")).alias("need"), count.alias("count"))


@query(
    "q01_active_works_deficit",
    f"""WITH {MEASURED}, t AS (SELECT row, work_id, CAST(coalesce(sum(CASE WHEN count IS NOT NULL THEN greatest(0, need - count) END), 0) AS BIGINT) AS missing,
    CAST(sum(need) AS BIGINT) AS needed, bool_and(need <= 0 OR count IS NOT NULL) AS complete FROM measured GROUP BY row, work_id)
    SELECT *, CASE WHEN needed > 0 THEN missing::DOUBLE / needed ELSE 0 END AS ratio FROM t""",
)
def active_works_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = measured(spark, sf_dir)
    return cascade.deficit(known, keys=["row", "work_id"])


@query("q02_plan_coverage", f"WITH {MEASURED} SELECT work_id, CAST(sum(CASE WHEN count IS NOT NULL THEN least(count, need) END) AS BIGINT) AS covered, CAST(sum(CASE WHEN count IS NOT NULL THEN greatest(0, count - need) END) AS BIGINT) AS excess, count(*) FILTER (count > need) AS excess_kinds, bool_or(count IS NOT NULL) AS any_known, bool_and(count IS NOT NULL) AS all_known FROM measured GROUP BY work_id")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.coverage(measured(spark, sf_dir), keys=["work_id"])


@query("q03_latest_by_group", f"WITH {OBS} SELECT run_id, arg_max(id, (clock, id)) AS id, max(clock) AS clock FROM obs GROUP BY run_id")
def latest_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_by(views.observations(spark, sf_dir).select("run_id", "clock", "id"), ["run_id"], "clock", "id")


@query("q04_keyset_page", "SELECT o_orderdate, o_orderkey, o_custkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    return paging.keyset_page(orders, ["o_orderdate", "o_orderkey"], 200, ["1998-06-01 00:00:00", 5000])


@query("q05_running_budget_page", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, sum(l_quantity) OVER w AS t, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR t <= 60")
def running_budget_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.budget_page(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_partkey", "l_shipdate"], "l_quantity", 60, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("q06_run_counts_left_join", "SELECT o_custkey, count(*) AS total, count(k) AS matched FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = k GROUP BY o_custkey")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.matched_counts(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), seen, "o_orderkey", "o_custkey")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.segments(views.observations(spark, sf_dir), max_gap=GAP)


def with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.durations(segmented(spark, sf_dir), step=6 * HOUR)


@query("q07_segments", f"WITH {SEGMENTS} SELECT id, run_id, segment FROM seg")
def segment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, sf_dir).select("id", "run_id", "segment")


@query("q08_sample_durations", f"WITH {SEGMENTS} SELECT id, CAST(span AS BIGINT) AS span FROM spans")
def sample_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(spark, sf_dir).select("id", F.col("span").cast("long").alias("span"))


@query("q09_bucket_last_and_sum", f"WITH {SEGMENTS} SELECT run_id, segment, clock // {DAY} AS bucket, count(*) AS sample_count, CAST(sum(span) AS BIGINT) AS seconds, arg_max(coalesce(raw_count, -1), (clock, id)) AS last_value FROM spans GROUP BY ALL")
def bucket_last_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(spark, sf_dir).withColumn("count", F.coalesce("raw_count", F.lit(-1)))
    found = series.buckets(rows, size=DAY)
    return found.withColumn("seconds", F.col("seconds").cast("long")).withColumn("bucket", F.col("bucket").cast("long"))


DEBOUNCE = f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, segment ORDER BY clock, id) AS rn FROM seg),
f AS (SELECT DISTINCT run_id, segment, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BIGINT AS clock, NULL::BIGINT AS raw_count, NULL::BIGINT AS count, '' AS presence, NULL::BIGINT AS zero_since, NULL::BIGINT AS level, NULL::BIGINT AS level_since, NULL::BOOLEAN AS upward FROM n
UNION ALL SELECT run_id, segment, rn, id, clock, raw_count, CASE kind WHEN 's' THEN raw_count WHEN 'z' THEN CASE WHEN done THEN 0 ELSE stable END WHEN 'l' THEN CASE WHEN done THEN lv ELSE stable END END,
  CASE WHEN kind = 'u' THEN 'unknown' WHEN kind = 's' THEN CASE WHEN raw_count > 0 THEN 'present' ELSE 'absent' END WHEN NOT done THEN 'pending' WHEN kind = 'z' THEN 'absent' ELSE 'present' END,
  CASE WHEN kind = 'z' AND NOT done THEN zs END, CASE WHEN kind = 'l' AND NOT done THEN lv END, CASE WHEN kind = 'l' AND NOT done THEN ls END, CASE WHEN kind = 'l' AND NOT done THEN up END
FROM (SELECT *, CASE kind WHEN 'z' THEN clock - zs >= {6 * HOUR} WHEN 'l' THEN clock - ls >= {4 * HOUR} END AS done
  FROM (SELECT *, CASE WHEN kind = 'z' THEN coalesce(zero_since, clock) END AS zs, CASE WHEN kind = 'l' THEN CASE WHEN upward IS DISTINCT FROM up THEN raw_count WHEN up THEN least(level, raw_count) ELSE greatest(level, raw_count) END END AS lv,
      CASE WHEN kind = 'l' THEN CASE WHEN upward IS DISTINCT FROM up THEN clock ELSE level_since END END AS ls
    FROM (SELECT n.run_id, n.segment, n.rn, n.id, n.clock, n.raw_count, f.count AS stable, f.zero_since, f.level, f.level_since, f.upward, n.raw_count > f.count AS up,
        CASE WHEN n.raw_count IS NULL THEN 'u' WHEN n.raw_count = f.count OR (f.count IS NULL AND n.raw_count > 0) THEN 's' WHEN n.raw_count = 0 THEN 'z' ELSE 'l' END AS kind
      FROM f JOIN n ON n.run_id = f.run_id AND n.segment = f.segment AND n.rn = f.rn + 1))))
SELECT run_id, segment, 'all' AS class_id, id, clock::DOUBLE AS clock, raw_count, count, presence FROM f WHERE rn > 0"""


@query("q10_debounce", DEBOUNCE)
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir).withColumn("class_id", F.lit("all"))
    return series.debounce(rows, absence=6.0 * HOUR, change=4.0 * HOUR)


@query("q11_display_confirmed", f"WITH {SEGMENTS}, b AS (SELECT *, clock // {DAY} AS bucket, coalesce(raw_count, -1) AS c FROM spans), l AS (SELECT run_id, segment, bucket, arg_max(c, (clock, id)) AS level FROM b GROUP BY ALL) SELECT run_id, segment, bucket, CASE WHEN sum(CASE WHEN c >= level THEN span ELSE 0 END) >= {3 * HOUR} THEN level END AS confirmed FROM b JOIN l USING (run_id, segment, bucket) GROUP BY run_id, segment, bucket, level")
def display_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(spark, sf_dir).withColumn("count", F.coalesce("raw_count", F.lit(-1)))
    return series.confirmed_levels(rows, size=DAY, least=3 * HOUR).withColumn("bucket", F.col("bucket").cast("long"))


@query("q12_activity_split", f"WITH {OBS}, d AS (SELECT run_id, clock // {DAY} AS day, count(*) FILTER (class_id = 'click') AS working, count(*) FILTER (class_id = 'view') AS idle, max(raw_count) AS most FROM obs GROUP BY ALL) SELECT run_id, day, CASE WHEN most IS NOT NULL THEN working END AS working, CASE WHEN most IS NOT NULL THEN idle END AS idle, CASE WHEN most IS NOT NULL THEN greatest(0, most - idle - working) END AS unknown FROM d")
def activity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = views.observations(spark, sf_dir).groupBy("run_id", F.floor(F.col("clock") / DAY).cast("long").alias("day"))
    rows = days.agg(F.count_if(F.col("class_id") == "click").alias("w"), F.count_if(F.col("class_id") == "view").alias("i"), F.max("raw_count").alias("most"))
    split = series.activity_split(F.col("i"), F.col("w"), F.col("most"), F.col("most"))
    return rows.select("run_id", "day", split.alias("s")).select("run_id", "day", "s.*")


@query("q13_partial_null_sum", f"WITH {OBS} SELECT run_id, clock // {DAY} AS day, CASE WHEN count(*) = count(raw_count) OR max(raw_count) > 0 THEN CAST(sum(raw_count) AS BIGINT) END AS total FROM obs GROUP BY ALL")
def partial_null_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = views.observations(spark, sf_dir).groupBy("run_id", F.floor(F.col("clock") / DAY).cast("long").alias("day"))
    return days.agg(series.partial_sum(F.col("raw_count")).alias("total"))


#: Zones: a triangle and a quadrangle.
ZONES = {"ramp": [(0.1, 0.1), (0.7, 0.15), (0.2, 0.6)], "yard": [(0.3, 0.2), (0.7, 0.2), (0.7, 0.65), (0.3, 0.5)]}


def _crossings(points: list[tuple[float, float]]) -> str:
    """Even-odd rule in SQL, for points that lie on no edge."""
    terms = []
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if ay != by:
            terms.append(f"CASE WHEN ({ay} > y2) <> ({by} > y2) AND (x1 + x2) / 2 < {ax} + (y2 - {ay}::DOUBLE) * ({bx}::DOUBLE - {ax}::DOUBLE) / ({by}::DOUBLE - {ay}::DOUBLE) THEN 1 ELSE 0 END")
    edges = " OR ".join(f"(abs(({bx}::DOUBLE - {ax}::DOUBLE) * (y2 - {ay}::DOUBLE) - ({by}::DOUBLE - {ay}::DOUBLE) * ((x1 + x2) / 2 - {ax}::DOUBLE)) <= 1e-9 AND (x1 + x2) / 2 BETWEEN {min(ax, bx)} - 1e-9 AND {max(ax, bx)} + 1e-9 AND y2 BETWEEN {min(ay, by)} - 1e-9 AND {max(ay, by)} + 1e-9)" for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True))
    return f"(({' + '.join(terms)}) % 2 = 1 OR {edges})"


@query("q14_point_in_polygon", f"WITH {DETECTIONS} SELECT class_id, count(*) FILTER ({_crossings(ZONES['ramp'])}) AS ramp, count(*) FILTER ({_crossings(ZONES['yard'])}) AS yard FROM det GROUP BY class_id")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("box.x1") + F.col("box.x2")) / 2, F.col("box.y2")
    return views.detections(spark, sf_dir).groupBy("class_id").agg(*[F.count_if(geometry.inside_fixed(x, y, points)).alias(n) for n, points in ZONES.items()])


@query("q15_excess_unexplained", f"WITH {MEASURED} SELECT m.row, m.work_id, m.class_id, m.count - m.need AS excess FROM measured m WHERE m.count > m.need AND NOT EXISTS (SELECT 1 FROM measured o WHERE o.row = m.row AND o.class_id = m.class_id AND o.work_id <> m.work_id AND o.need > 0)")
def excess_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir)
    needed = rows.filter("need > 0").select(F.col("row").alias("_row"), F.col("class_id").alias("_class"), F.col("work_id").alias("_work"))
    other = (F.col("row") == F.col("_row")) & (F.col("class_id") == F.col("_class")) & (F.col("work_id") != F.col("_work"))
    return rows.filter("count > need").join(needed, other, "left_anti").select("row", "work_id", "class_id", (F.col("count") - F.col("need")).alias("excess"))


def batch_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episodes(views.findings(views.observations(spark, sf_dir)), allowed=GAP, visible_after=5 * HOUR, critical_after=10 * HOUR)


@query("q16_episodes", f"WITH {EPISODES} SELECT fingerprint, episode, first_seen, last_seen, status, duration, suppressed FROM done")
def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_episodes(spark, sf_dir).drop("critical_duration", "severity")


@query("q17_critical_duration", f"WITH {EPISODES} SELECT fingerprint, episode, CAST(critical_duration AS BIGINT) AS critical_duration, severity FROM done")
def critical_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_episodes(spark, sf_dir).select("fingerprint", "episode", F.col("critical_duration").cast("long").alias("critical_duration"), "severity")


@query("q18_alert_dedupe_open_count", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderpriority <> '5-LOW') SELECT o_custkey AS fingerprint, count(*) AS alerts, count(*) FILTER (o_orderstatus = 'O') AS open FROM a WHERE n = 1 GROUP BY o_custkey")
def dedupe_open_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved")
    alerts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fingerprint"), (F.col("o_orderkey") % 3).alias("episode"), F.col("o_orderdate").alias("last_seen"), F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderpriority") == "5-LOW").alias("suppressed"))
    return episodes.open_alerts(alerts)


@query("q19_state_durations", f"""WITH {OBS}, a AS (SELECT *, coalesce(raw_count < 2, false) AS low, clock - lag(clock) OVER w AS gap, coalesce(lead(clock) OVER w - clock, 0) AS owned FROM obs WINDOW w AS (PARTITION BY run_id ORDER BY clock, id)),
p AS (SELECT *, lag(low) OVER (PARTITION BY run_id ORDER BY clock, id) AS low_before FROM a),
b AS (SELECT *, sum(CASE WHEN low AND (coalesce(NOT low_before, true) OR coalesce(gap > {GAP}, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clock, id) AS island FROM p),
c AS (SELECT *, min(CASE WHEN low THEN clock END) OVER (PARTITION BY run_id, island) AS since FROM b),
d AS (SELECT run_id, owned, CASE WHEN owned > {GAP} THEN 'unknown' WHEN raw_count IS NULL THEN 'unknown' WHEN NOT low THEN 'present' WHEN clock - since >= {6 * HOUR} THEN 'absent' ELSE 'pending' END AS state FROM c)
SELECT run_id, state, count(*) AS samples, CAST(sum(owned) AS BIGINT) AS owned FROM d GROUP BY run_id, state""")
def state_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = series.absence_states(views.observations(spark, sf_dir), need=F.lit(2), confirm=6 * HOUR, allowed=GAP, value="raw_count")
    return stated.groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("samples"), F.sum("owned").cast("long").alias("owned"))


@query("q20_keyframes", f"WITH {OBS}, n AS (SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY clock, id) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM obs) SELECT run_id, id FROM n WHERE n <= 6 OR pos IN (0, CAST(round_even((n - 1) / 5.0::DOUBLE, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT), CAST(round_even(3 * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT), CAST(round_even(4 * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT), n - 1)")
def keyframe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.keyframes(views.observations(spark, sf_dir)).select("run_id", "id")


@query("q21_report_pivot", "SELECT o_orderkey, l_linestatus AS split, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS BIGINT) AS a_count, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS BIGINT) AS n_count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS BIGINT) AS r_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("split"), "l_returnflag", "l_quantity")
    kept = lines.join(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey")
    return kept.groupBy("o_orderkey", "split").agg(*[F.sum(F.when(F.col("l_returnflag") == c, F.col("l_quantity"))).cast("long").alias(f"{c.lower()}_count") for c in views.CLASSES])


@query("q22_predecessors", "SELECT p_partkey, count(*) OVER w AS n_before, max(p_retailprice) OVER w AS latest_end FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey % 40 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def plan_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 40).cast("string"))
    works = table(spark, sf_dir, "part").withColumn("key", text.code_key(code))
    return cascade.predecessors(works, plan="p_brand", key="key", ends="p_retailprice").select("p_partkey", "n_before", "latest_end")


@query("q23_cascade_shift", f"WITH RECURSIVE {WORKS}, n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY work_id) AS rn FROM works), f AS (SELECT plan_id, work_id, rn, starts::DOUBLE AS starts, ends + 45::DOUBLE AS ends, ends + 45::DOUBLE AS top, true AS changed FROM n WHERE rn = 1 UNION ALL SELECT n.plan_id, n.work_id, n.rn, n.starts + greatest(0, f.top - n.starts), n.ends + greatest(0, f.top - n.starts), greatest(f.top, n.ends + greatest(0, f.top - n.starts)), f.top > n.starts FROM f JOIN n ON n.plan_id = f.plan_id AND n.rn = f.rn + 1) SELECT plan_id, work_id, starts, ends, changed FROM f")
def cascade_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = views.works(spark, sf_dir)
    first = works.groupBy("plan_id").agg(F.min("work_id").alias("first"))
    marked = works.join(first, "plan_id")
    return cascade.shift(marked, plan="plan_id", order=["work_id"], starts="starts", ends="ends", target=F.col("work_id") == F.col("first"), by=45)


@query("q24_code_sort", "SELECT p_partkey, code, row_number() OVER (PARTITION BY p_brand ORDER BY a, b, p_partkey) AS rank FROM (SELECT *, p_size AS a, p_partkey % 40 AS b, p_size || '.' || (p_partkey % 40) AS code FROM part)")
def code_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "part").withColumn("code", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 40).cast("string")))
    return curation.ranked(coded, "p_brand", text.code_key(F.col("code")), F.col("p_partkey")).select("p_partkey", "code", "rank")


@query("q25_text_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(text.matches_search(F.col("p_name"), "Ring RED")).select("p_partkey", "p_name")


@query("q26_period_overlap", f"WITH {EPISODES} SELECT fingerprint, episode FROM done WHERE last_seen >= epoch_us(TIMESTAMP '2024-01-10') AND first_seen < epoch_us(TIMESTAMP '2024-01-12') AND status <> 'unknown' AND NOT suppressed")
def period_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda day: F.unix_micros(F.lit(day).cast("timestamp"))
    found = batch_episodes(spark, sf_dir).withColumn("message", F.lit("short")).withColumn("confirmed", F.lit(None).cast("boolean"))
    return episodes.relevant(found).filter((F.col("last_seen") >= edge("2024-01-10")) & (F.col("first_seen") < edge("2024-01-12"))).select("fingerprint", "episode")


@query("q27_exact_dedup_representative", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.exact_groups(table(spark, sf_dir, "documents"), record="doc_id", content=F.col("text"))


@query("q28_components", "WITH RECURSIVE e AS (SELECT doc_id, 't' || md5(text) AS k FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 's' || source || '/' || (doc_id // 25) FROM documents WHERE source IS NOT NULL), r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.doc_id, r.root FROM r JOIN e a ON a.doc_id = r.doc_id JOIN e b ON a.k = b.k) SELECT doc_id, min(root) AS component FROM r GROUP BY doc_id")
def record_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scene = F.concat(F.lit("s"), F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 25).cast("string"))
    keys = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("t"), F.md5(F.col("text").cast("binary"))), scene, F.concat(F.lit("d"), F.col("doc_id").cast("string")))).alias("key"))
    return curation.components(spark, keys.filter("key is not null"), record="doc_id", key="key")


@query("q29_topk_per_group_versions", "SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS version FROM lineitem QUALIFY version <= 3")
def topk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_shipdate")]
    return joins.top_per_group(table(spark, sf_dir, "lineitem"), ["l_partkey"], order, 3).select("l_partkey", "l_orderkey", "l_linenumber", F.col("version").cast("long").alias("version"))


@query("q31_hamming_pairs", "WITH b AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 25), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (24 - i) ELSE 0 END)) AS BIGINT) AS bits FROM embeddings WHERE len(embedding) >= 24) SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) <= 4")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of 24 components, so that some of the test vectors are near each other."""
    hashed = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 24).select("vec_id", joins.sign_bits(F.slice("embedding", 1, 24)).alias("bits"))
    return joins.hamming_pairs(hashed, key="vec_id", bits="bits", most=4, width=24)


@query("q32_js_divergence", "WITH c AS (SELECT l_shipdate, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS divergence FROM s")
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.divergence(table(spark, sf_dir, "lineitem"), split="l_linestatus", kind="l_shipdate", a="F", b="O").select(F.round("divergence", 6).alias("divergence"))


@query("q33_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS deviation FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90", "mean", "deviation")])


@query("q34_jaccard", "WITH s AS (SELECT l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity < 10 GROUP BY 1) SELECT count(*) FILTER (a AND b) AS shared, count(*) AS total, count(*) FILTER (a AND b) / count(*)::DOUBLE AS similarity FROM s")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.jaccard(table(spark, sf_dir, "lineitem").filter("l_quantity < 10"), split="l_returnflag", value="l_partkey", a="A", b="R")


@query("q35_class_pivot_by_split", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F_objects, count(*) FILTER (l_linestatus = 'O') AS O_objects, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS F_records, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS O_records FROM lineitem GROUP BY 1")
def class_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.class_pivot(table(spark, sf_dir, "lineitem"), kind="l_returnflag", split="l_linestatus", record="l_orderkey", splits=["F", "O"])


@query("q37_anti_missing_orphan", "SELECT o_orderkey AS k, 'right' AS absent FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) UNION ALL SELECT DISTINCT l_orderkey, 'left' FROM lineitem WHERE l_quantity > 25 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def anti_missing_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("k"))
    return joins.orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), big, "k")


@query("q38_leakage", "SELECT l_partkey, count(DISTINCT l_linestatus) AS splits, count(*) AS records FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.leaks(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linestatus")


@query("q40_top1_share", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority AS top, n, n / sum(n) OVER (PARTITION BY o_custkey) AS share FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def top1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_share(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("q41_case_ladder", "WITH n AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb FROM lineitem GROUP BY 1) SELECT l_partkey, na, nb, na / nullif(nb, 0)::DOUBLE AS ratio, CASE WHEN nb = 0 THEN 'no base' WHEN na / nb::DOUBLE < 0.5 THEN 'add' WHEN na / nb::DOUBLE > 2 THEN 'thin out' ELSE 'keep' END AS advice FROM n")
def case_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.prevalence(table(spark, sf_dir, "lineitem"), kind="l_partkey", split="l_linestatus", a="F", b="O")


@query("q42_iou_pairs", f"WITH {DETECTIONS}, p AS (SELECT a.frame_id, a.row AS a, b.row AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS both_, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS sum_ FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.row < b.row) SELECT frame_id, a, b, round(both_ / (sum_ - both_), 6) AS iou FROM p WHERE both_ / (sum_ - both_) > 0.1")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = views.detections(spark, sf_dir).select("frame_id", "row", "box")
    x, y = boxes.select("frame_id", F.col("row").alias("a"), F.col("box").alias("u")), boxes.select("frame_id", F.col("row").alias("b"), F.col("box").alias("v"))
    pairs = x.join(y, "frame_id").filter("a < b").withColumn("iou", geometry.iou(F.col("u"), F.col("v")))
    return pairs.filter("iou > 0.1").select("frame_id", "a", "b", F.round("iou", 6).alias("iou"))


NMS = f"""WITH RECURSIVE {DETECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, row, x1, y1, x2, y2) AS rn FROM det),
f AS (SELECT frame_id, class_id, rn, row, score, true AS stays, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM n WHERE rn = 1
UNION ALL SELECT frame_id, class_id, rn, row, score, stays, CASE WHEN stays THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END
FROM (SELECT n.*, f.kept, len(list_filter(f.kept, lambda k: greatest(least(k.x2, n.x2) - greatest(k.x1, n.x1), 0) * greatest(least(k.y2, n.y2) - greatest(k.y1, n.y1), 0) >
    0.3 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(least(k.x2, n.x2) - greatest(k.x1, n.x1), 0) * greatest(least(k.y2, n.y2) - greatest(k.y1, n.y1), 0)))) = 0 AS stays
  FROM f JOIN n ON n.frame_id = f.frame_id AND n.class_id = f.class_id AND n.rn = f.rn + 1))
SELECT frame_id, class_id, row, score FROM f WHERE stays"""


@query("q43_nms", NMS)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.suppress(views.detections(spark, sf_dir), frame="frame_id", box="box", score="score", kind="class_id", row="row", threshold=0.3)


@query("q44_idempotent_replay", "SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.unique_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("q45_lease_eligible", "SELECT o_custkey, min(o_orderkey) AS job FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01') GROUP BY o_custkey")
def lease_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = (F.col("o_orderstatus") == "O") | ((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
    return table(spark, sf_dir, "orders").filter(free).groupBy("o_custkey").agg(F.min("o_orderkey").alias("job"))


@query("q46_stream_equals_batch", f"WITH {EPISODES} SELECT fingerprint, episode, first_seen::DOUBLE AS first_seen, last_seen::DOUBLE AS last_seen, status, duration::DOUBLE AS duration, critical_duration::DOUBLE AS critical_duration, severity, suppressed FROM done")
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # the batch leaves an episode that nothing follows as it is, so no timer may close one here
    versions = monitor.monitored(views.findings(views.as_observations(stream)), allowed=GAP, visible_after=5 * HOUR, critical_after=10 * HOUR, unit=1e6, delay="36500 days")
    root = f"{shared_folder(spark)}/groma-stream-{uuid.uuid4().hex}"
    last = monitor.latest(monitor.run_available(versions, f"{root}/out", f"{root}/state"), ["fingerprint", "first_seen"])
    numbered = Ordered.of(last, ["fingerprint"], ["first_seen"]).numbered("episode", "_n").done()
    return numbered.select("fingerprint", F.col("episode").cast("long").alias("episode"), "first_seen", "last_seen", "status", "duration", "critical_duration", "severity", "suppressed")


@query("q49_table_digest")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.digest(table(spark, sf_dir, "lineitem"))


CELLS = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query("q181_portable_digest", f"SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS HUGEINT)) AS VARCHAR) AS checksum, CAST(sum(CAST(('0x' || substr(h, 18, 15)) AS HUGEINT)) AS VARCHAR) AS checksum_end FROM (SELECT md5({CELLS}) AS h FROM lineitem)")
def portable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.portable_digest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])
