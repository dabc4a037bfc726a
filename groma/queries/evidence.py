"""Time series and evidence: seconds in states, windows, runs of equal values, what belongs to which alert."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.catalogue import DAY, EPISODES, GAP, HOUR, OBS, SEGMENTS, batch_episodes, query, segmented, with_spans
from groma.operators import curation, episodes, joins, series
from groma.operators.ordered import Ordered
from groma.sources import views
from groma.sources.scratch import shared_folder
from groma.sources.views import table
from groma.streaming import monitor, notices, replay


@query("q103_state_seconds", f"WITH {SEGMENTS} SELECT run_id, CAST(coalesce(sum(CASE WHEN class_id = 'click' THEN raw_count * span END), 0) AS BIGINT) AS working, CAST(coalesce(sum(CASE WHEN class_id = 'view' THEN raw_count * span END), 0) AS BIGINT) AS idle, CAST(coalesce(sum(CASE WHEN raw_count IS NULL THEN span END), 0) AS BIGINT) AS unknown FROM spans GROUP BY run_id")
def state_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.when(F.col("class_id") == c, F.col("raw_count"))
    states = {"working": of("click"), "idle": of("view"), "unknown": F.when(F.col("raw_count").isNull(), 1)}
    found = series.state_seconds(with_spans(spark, sf_dir), states=states)
    return found.select("run_id", *[F.col(c).cast("long").alias(c) for c in states])


@query("q104_display_from", f"WITH {SEGMENTS} SELECT run_id, segment, clock // {DAY} AS bucket, count(*) AS sample_count, CAST(sum(span) AS BIGINT) AS seconds FROM spans WHERE clock >= epoch_us(TIMESTAMP '2024-01-15') GROUP BY ALL")
def display_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown from a date on: state is replayed over all samples first, so segments keep their numbers, and the filter comes after it."""
    shown = with_spans(spark, sf_dir).filter(F.col("clock") >= F.unix_micros(F.lit("2024-01-15").cast("timestamp")))
    found = series.buckets(shown, size=DAY, value="raw_count")
    return found.select("run_id", "segment", F.col("bucket").cast("long").alias("bucket"), "sample_count", F.col("seconds").cast("long").alias("seconds"))


@query("q105_run_lengths", f"WITH {OBS}, m AS (SELECT *, sum(CASE WHEN raw_count IS DISTINCT FROM before OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clock, id) AS r FROM (SELECT *, lag(raw_count) OVER w AS before, row_number() OVER w AS n FROM obs WINDOW w AS (PARTITION BY run_id ORDER BY clock, id))) SELECT run_id, any_value(raw_count) AS raw_count, min(clock) AS first, max(clock) AS last, count(*) AS n FROM m GROUP BY run_id, r")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.run_lengths(views.observations(spark, sf_dir), run="run_id", clock="clock", row="id", value="raw_count")


@query("q106_linked_points", f"WITH {OBS} SELECT id, coalesce(lead(clock) OVER (PARTITION BY run_id ORDER BY clock, id) - clock <= {15 * HOUR}, false) AS linked FROM obs")
def linked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.linked(views.observations(spark, sf_dir), run="run_id", clock="clock", row="id", step=10 * HOUR).select("id", "linked")


@query("q107_viewing_window", f"WITH {OBS} SELECT run_id, id FROM obs WHERE clock >= (SELECT max(clock) FROM obs o WHERE o.run_id = obs.run_id) - {60 * HOUR}")
def viewing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.viewing_window(views.observations(spark, sf_dir), run="run_id", clock="clock", length=60 * HOUR).select("run_id", "id")


@query("q108_presence_summary", f"WITH {SEGMENTS}, t AS (SELECT run_id, sum(span) AS known, sum(CASE WHEN raw_count > 0 THEN span END) AS there, count(raw_count) AS n, count(*) FILTER (raw_count > 0) AS n_there FROM spans GROUP BY run_id) SELECT run_id, CASE WHEN known > 0 THEN 'time' ELSE 'samples' END AS basis, CASE WHEN known > 0 THEN coalesce(there, 0) / known::DOUBLE ELSE n_there / nullif(n, 0)::DOUBLE END AS share FROM t")
def presence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the time that something was there; of the samples where no time is known."""
    there = F.col("raw_count") > 0
    t = with_spans(spark, sf_dir).groupBy("run_id").agg(F.sum("span").alias("known"), F.coalesce(F.sum(F.when(there, F.col("span"))), F.lit(0)).alias("there"), F.count("raw_count").alias("n"), F.count_if(there).alias("n_there"))
    timed = F.col("known") > 0
    return t.select("run_id", F.when(timed, "time").otherwise("samples").alias("basis"), F.when(timed, F.try_divide("there", "known")).otherwise(F.try_divide("n_there", "n")).cast("double").alias("share"))


@query("q109_activity_summary", f"WITH {OBS}, d AS (SELECT run_id, clock // {DAY} AS day, max(raw_count) AS most, count(*) FILTER (class_id = 'click') AS working, count(*) FILTER (class_id = 'view') AS idle FROM obs GROUP BY ALL), r AS (SELECT run_id, most, least(working, most) AS working, least(idle, most - least(working, most)) AS idle FROM d WHERE most IS NOT NULL) SELECT run_id, CAST(sum(working) AS BIGINT) AS working, CAST(sum(idle) AS BIGINT) AS idle, CAST(sum(most - working - idle) AS BIGINT) AS unknown FROM r GROUP BY run_id")
def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working and idle are capped by what was counted; the rest is unknown."""
    days = views.observations(spark, sf_dir).groupBy("run_id", F.floor(F.col("clock") / DAY).alias("day")).agg(F.max("raw_count").alias("most"), F.count_if(F.col("class_id") == "click").alias("w"), F.count_if(F.col("class_id") == "view").alias("i"))
    working = F.least("w", "most")
    rows = days.filter("most is not null").select("run_id", "most", working.alias("working"), F.least(F.col("i"), F.col("most") - working).alias("idle"))
    return rows.groupBy("run_id").agg(F.sum("working").alias("working"), F.sum("idle").alias("idle"), F.sum(F.col("most") - F.col("working") - F.col("idle")).alias("unknown"))


@query("q110_period_extremes", f"WITH {OBS} SELECT run_id, class_id, max(raw_count) AS most, arg_max(raw_count, (clock, id)) FILTER (raw_count IS NOT NULL) AS last FROM obs WHERE class_id <> 'error' GROUP BY ALL")
def period_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir).filter("class_id <> 'error' and raw_count is not null")
    return rows.groupBy("run_id", "class_id").agg(F.max("raw_count").alias("most"), F.max_by("raw_count", F.struct("clock", "id")).alias("last"))


@query("q111_overview", f"""WITH {EPISODES}, s AS (SELECT user_id AS run_id, count(*) AS samples, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1), a AS (SELECT CAST(fingerprint AS BIGINT) AS run_id, count(*) FILTER (status IN ('open', 'unknown')) AS current, count(*) FILTER (status NOT IN ('open', 'unknown')) AS past, count(*) FILTER (severity = 'critical') AS critical FROM done GROUP BY 1)
SELECT CAST(s.run_id AS BIGINT) AS run_id, samples, kinds, coalesce(current, 0) AS current, coalesce(past, 0) AS past, coalesce(critical, 0) AS critical FROM s LEFT JOIN a ON a.run_id = s.run_id""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("run_id")).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("event_type").alias("kinds"))
    live = F.col("status").isin("open", "unknown")
    alerts = batch_episodes(spark, sf_dir).groupBy(F.col("fingerprint").cast("long").alias("run_id")).agg(F.count_if(live).alias("current"), F.count_if(~live).alias("past"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return seen.join(alerts, "run_id", "left").fillna(0, ["current", "past", "critical"])


@query("q112_project_summary", "WITH w AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1998-06-01' AND o_orderdate + INTERVAL 40 DAY > TIMESTAMP '1998-06-01') AS current_works FROM orders GROUP BY 1), s AS (SELECT o_custkey AS k, count(DISTINCT l_suppkey) AS sources, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) AS live FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, coalesce(current_works, 0) AS current_works, coalesce(sources, 0) AS sources, coalesce(live, 0) AS live FROM customer LEFT JOIN w ON w.k = c_custkey LEFT JOIN s ON s.k = c_custkey")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("starts"))
    now = F.lit("1998-06-01").cast("timestamp")
    open_now = (F.col("o_orderstatus") != "F") & (F.col("starts") <= now) & (F.col("starts") + F.expr("interval 40 days") > now)
    works = orders.groupBy("c_custkey").agg(F.count_if(open_now).alias("current_works"))
    lines = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus"), "l_orderkey")
    sources = lines.groupBy("c_custkey").agg(F.count_distinct("l_suppkey").alias("sources"), F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("live"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(works, "c_custkey", "left").join(sources, "c_custkey", "left").fillna(0)


@query("q113_class_sets", "SELECT o_custkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS classes, count(DISTINCT l_returnflag) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("classes"))
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    union = held.groupBy("o_custkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("c"))
    return union.select("o_custkey", F.array_join("c", ",").alias("classes"), F.size("c").cast("long").alias("n"))


@query("q114_nearest_in_time", f"""WITH {OBS}, e AS (SELECT run_id, clock, min(id) AS value FROM obs WHERE class_id = 'click' GROUP BY ALL), p AS (SELECT o.id, o.clock, e.clock AS t, e.value FROM obs o LEFT JOIN e ON e.run_id = o.run_id WHERE o.class_id = 'error')
SELECT id, arg_min(t, (abs(t - clock), t)) AS near_at, arg_min(value, (abs(t - clock), t)) AS near_value FROM p GROUP BY id""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views.observations(spark, sf_dir)
    there = seen.filter("class_id = 'click'").select("run_id", "clock", F.col("id").alias("value"))
    return joins.nearest_in_time(seen.filter("class_id = 'error'").select("id", "run_id", "clock"), there, key="run_id", at="clock", value="value").select("id", "near_at", "near_value")


@query("q115_alert_results", """WITH a AS (SELECT o_orderkey AS alert, o_custkey % 200 AS frame, o_orderkey % 9 AS region, 'z' || o_orderkey % 4 AS zone FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT c_custkey AS result, c_custkey % 200 AS frame, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 END AS r_region, 'z' || c_nationkey % 4 AS r_zone FROM customer),
j AS (SELECT *, CASE WHEN region = r_region THEN 0 WHEN zone = r_zone THEN 1 ELSE 2 END AS rank FROM a LEFT JOIN r USING (frame)) SELECT alert, arg_min(result, (rank, result)) AS result, CASE WHEN arg_min(result, (rank, result)) IS NOT NULL THEN CAST(min(rank) AS INTEGER) END AS rule FROM j GROUP BY alert""")
def alert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result that an alert came from: by region, else by the region's name, else the frame's first."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    alerts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(k.alias("alert"), (F.col("o_custkey") % 200).alias("frame"), (k % 9).alias("region"), F.concat(F.lit("z"), (k % 4).cast("string")).alias("zone"))
    results = table(spark, sf_dir, "customer").select(c.alias("result"), (c % 200).alias("frame"), F.when(c % 3 == 0, c % 9).alias("r_region"), F.concat(F.lit("z"), (F.col("c_nationkey") % 4).cast("string")).alias("r_zone"))
    rules = [({"region": "r_region"}, None), ({"zone": "r_zone"}, None)]
    return joins.first_match(alerts, results, key="frame", rules=rules, value="result", order="result").select("alert", "result", "rule")


@query("q116_alert_tabs", f"WITH {EPISODES} SELECT fingerprint, count(*) AS all_, count(*) FILTER (status = 'open') AS open, count(*) FILTER (severity = 'critical' AND NOT suppressed) AS critical, count(*) FILTER (status = 'resolved' AND episode % 2 = 0) AS reviewed FROM done GROUP BY fingerprint")
def alert_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch_episodes(spark, sf_dir)
    tabs = episodes.tabs(reviewed=(F.col("status") == "resolved") & (F.col("episode") % 2 == 0))
    return found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("all_"), *[F.count_if(c).alias(n) for n, c in tabs.items()])


@query("q117_timeline_rows", f"WITH {OBS}, d AS (SELECT run_id, clock // {DAY} AS day, max(raw_count) AS total, count(*) FILTER (class_id = 'click') AS w, count(*) FILTER (class_id = 'view') AS i, count(*) FILTER (class_id = 'buy') AS c FROM obs GROUP BY ALL) SELECT run_id, day, total, least(w, total) AS working, least(i, greatest(0, total - least(w, total))) AS idle, greatest(0, total - least(w, total) - least(i, greatest(0, total - least(w, total)))) AS unknown, least(c, least(w, total)) AS continued, CASE WHEN total < 2 THEN 'below' WHEN total = 2 THEN 'match' ELSE 'above' END AS level FROM d WHERE total IS NOT NULL")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count_if(F.col("class_id") == c)
    days = views.observations(spark, sf_dir).groupBy("run_id", F.floor(F.col("clock") / DAY).cast("long").alias("day")).agg(F.max("raw_count").alias("total"), n("click").alias("w"), n("view").alias("i"), n("buy").alias("c")).filter("total is not null")
    total = F.col("total")
    working = F.least("w", total)
    idle = F.least(F.col("i"), F.greatest(F.lit(0), total - working))
    level = F.when(total < 2, "below").when(total == 2, "match").otherwise("above")
    return days.select("run_id", "day", "total", working.alias("working"), idle.alias("idle"), F.greatest(F.lit(0), total - working - idle).alias("unknown"), F.least(F.col("c"), working).alias("continued"), level.alias("level"))


@query("q118_unplanned_classes", "SELECT o_custkey, l_returnflag, max(l_quantity) AS most FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE (o_custkey % 3 = 0 AND l_returnflag <> 'A') OR (o_custkey % 3 <> 0 AND l_returnflag = 'R') GROUP BY ALL HAVING max(l_quantity) > 20")
def unplanned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that were seen but are in no plan."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    seen = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    listed = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("N")))
    planned = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(listed).alias("l_returnflag"))
    most = seen.groupBy("o_custkey", "l_returnflag").agg(F.max("l_quantity").alias("most"))
    return most.join(planned, ["o_custkey", "l_returnflag"], "left_anti").filter("most > 20")


@query("q119_run_attempts", f"WITH {OBS}, g AS (SELECT *, clock - lag(clock) OVER (PARTITION BY run_id ORDER BY clock, id) AS gap FROM obs) SELECT run_id, CAST(attempt AS BIGINT) AS attempt, count(*) AS samples, min(clock) AS first, max(clock) AS last FROM (SELECT *, 1 + sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clock, id) AS attempt FROM g) GROUP BY run_id, attempt")
def run_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interrupted stream begins a new attempt of its own."""
    rows = Ordered.of(views.observations(spark, sf_dir), ["run_id"], ["clock", "id"]).neighbours(before={"_clock": F.col("clock")})
    gap = F.coalesce(F.col("clock") - F.col("_clock") > GAP, F.lit(False))
    numbered = rows.running(gap.cast("int"), "_gaps").done().withColumn("attempt", 1 + F.col("_gaps"))
    found = numbered.groupBy("run_id", "attempt").agg(F.count(F.lit(1)).alias("samples"), F.min("clock").alias("first"), F.max("clock").alias("last"))
    return found


@query("q120_request_classes", "WITH r AS (SELECT event_id, user_id % 40 AS scope, event_id % 50 AS key, CAST(floor(value) AS BIGINT) % 2 AS hash FROM events), f AS (SELECT *, first_value(hash) OVER w AS first_hash, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY scope, key ORDER BY event_id)) SELECT event_id, CASE WHEN n = 1 THEN 'insert' WHEN hash = first_hash THEN 'replay' ELSE 'conflict' END AS outcome FROM f")
def request_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("scope"), (F.col("event_id") % 50).alias("key"), (F.floor("value").cast("long") % 2).alias("hash"))
    return episodes.request_outcomes(requests, keys=["scope", "key"], order="event_id", content="hash").select("event_id", "outcome")


DRIFTING = f"""WITH RECURSIVE {OBS}, n AS (SELECT run_id, clock, id, row_number() OVER (PARTITION BY run_id ORDER BY clock, id) AS rn FROM obs),
f AS (SELECT run_id, clock, id, rn, true AS keeps, clock::DOUBLE + {12 * HOUR} AS due FROM n WHERE rn = 1
UNION ALL SELECT n.run_id, n.clock, n.id, n.rn, n.clock + 0.001::DOUBLE >= f.due, CASE WHEN n.clock + 0.001::DOUBLE >= f.due THEN n.clock + {12 * HOUR}::DOUBLE ELSE f.due END FROM f JOIN n ON n.run_id = f.run_id AND n.rn = f.rn + 1)
SELECT run_id, clock::DOUBLE AS clock, id FROM f WHERE keeps"""


@query("q121_drifting_sample", DRIFTING)
def drifting_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sampled(views.observations(spark, sf_dir), step=12.0 * HOUR)


@query("q122_segment_sizes", f"WITH {SEGMENTS} SELECT n, count(*) AS segments FROM (SELECT run_id, segment, count(*) AS n FROM seg GROUP BY ALL) GROUP BY n")
def segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = segmented(spark, sf_dir).groupBy("run_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("segments"))


@query("q173_coarse_samples", f"WITH {SEGMENTS} SELECT id, 0 AS span FROM seg")
def coarse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples six hours apart, where two are the most that a sample can stand for."""
    return series.durations(segmented(spark, sf_dir), step=6 * HOUR, finest=2 * HOUR).select("id", "span")


@query("q174_bucket_states", f"WITH {SEGMENTS} SELECT run_id, segment, clock // {DAY} AS bucket, count(*) AS sample_count, CAST(coalesce(sum(CASE WHEN class_id = 'click' THEN raw_count * span END), 0) AS BIGINT) AS working, CAST(coalesce(sum(CASE WHEN class_id = 'view' THEN raw_count * span END), 0) AS BIGINT) AS idle, arg_max(id, (clock, id)) AS last_row FROM spans GROUP BY ALL")
def bucket_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.when(F.col("class_id") == c, F.col("raw_count"))
    found = series.bucket_states(with_spans(spark, sf_dir), size=DAY, states={"working": of("click"), "idle": of("view")})
    return found.select("run_id", "segment", "sample_count", "last_row", *[F.col(c).cast("long").alias(c) for c in ("bucket", "working", "idle")])


@query("q175_absence_ratios", f"""WITH {OBS}, a AS (SELECT *, coalesce(raw_count < 2, false) AS low, clock - lag(clock) OVER w AS gap, coalesce(lead(clock) OVER w - clock, 0) AS owned FROM obs WINDOW w AS (PARTITION BY run_id ORDER BY clock, id)),
p AS (SELECT *, lag(low) OVER (PARTITION BY run_id ORDER BY clock, id) AS low_before FROM a),
b AS (SELECT *, sum(CASE WHEN low AND (coalesce(NOT low_before, true) OR coalesce(gap > {GAP}, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clock, id) AS island FROM p),
c AS (SELECT *, min(CASE WHEN low THEN clock END) OVER (PARTITION BY run_id, island) AS since FROM b),
d AS (SELECT run_id, owned, CASE WHEN owned > {GAP} THEN 'unknown' WHEN raw_count IS NULL THEN 'unknown' WHEN NOT low THEN 'present' WHEN clock - since >= {6 * HOUR} THEN 'absent' ELSE 'pending' END AS state FROM c),
t AS (SELECT run_id, CAST(coalesce(sum(owned) FILTER (state = 'present'), 0) AS BIGINT) AS present, CAST(coalesce(sum(owned) FILTER (state = 'absent'), 0) AS BIGINT) AS absent, CAST(coalesce(sum(owned) FILTER (state = 'pending'), 0) AS BIGINT) AS pending, CAST(coalesce(sum(owned) FILTER (state = 'unknown'), 0) AS BIGINT) AS unknown FROM d GROUP BY run_id)
SELECT *, absent / nullif(present + absent, 0)::DOUBLE AS absence_ratio FROM t""")
def absence_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = series.absence_states(views.observations(spark, sf_dir), need=F.lit(2), confirm=6 * HOUR, allowed=GAP, value="raw_count")
    found = series.absence_ratios(stated.withColumn("owned", F.col("owned").cast("long")))
    return found


@query("q176_event_report", f"""WITH {EPISODES} SELECT fingerprint || '#' || episode AS event, strftime(make_timestamp(first_seen) + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M:%S') AS begun, strftime(make_timestamp(last_seen) + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M:%S') AS ended, CAST(duration // 60000000 AS BIGINT) AS minutes, status, severity,
  4 AS expected_a, CASE WHEN severity = 'critical' THEN 0 END AS seen_a FROM done WHERE NOT suppressed AND status <> 'unknown'""")
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are reported: local times, whole minutes, what was expected and seen of each class."""
    return episodes.report(batch_episodes(spark, sf_dir), zone="+03:00", classes={"a": (F.lit(4), F.when(F.col("severity") == "critical", 0))})


@query("q177_fullest_duplicate", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY n_chars % 7 DESC, source NULLS FIRST, doc_id) AS representative, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL")
def fullest_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal pictures the one with the most boxes, then by data set, then by name."""
    return curation.exact_groups(table(spark, sf_dir, "documents"), record="doc_id", content=F.col("text"), order=[-(F.col("n_chars") % 7), F.col("source")])


@query("q178_finding_alerts", """WITH f AS (SELECT c_custkey AS finding, c_custkey % 300 AS work FROM customer), a AS (SELECT o_orderkey AS alert, o_custkey % 300 AS work, o_orderkey % 1500 AS evidence, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 = 0),
j AS (SELECT *, CASE WHEN evidence = finding THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS rank FROM f LEFT JOIN a USING (work)) SELECT finding, arg_min(alert, (rank, alert)) AS alert, CASE WHEN arg_min(alert, (rank, alert)) IS NOT NULL THEN CAST(min(rank) AS INTEGER) END AS rule FROM j GROUP BY finding""")
def finding_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert of a finding: the one with the same evidence, else an open one, else the first."""
    k = F.col("o_orderkey")
    alerts = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P' and o_orderkey % 5 = 0").select(k.alias("alert"), (F.col("o_custkey") % 300).alias("work"), (k % 1500).alias("evidence"), "o_orderstatus")
    findings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding"), (F.col("c_custkey") % 300).alias("work"))
    rules = [({"finding": "evidence"}, None), ({}, F.col("o_orderstatus") == "O")]
    return joins.first_match(findings, alerts, key="work", rules=rules, value="alert", order="alert").select("finding", "alert", "rule")


@query("q180_stream_replay", "SELECT event_id, user_id, event_type FROM events")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that comes twice over, taken once."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    root = f"{shared_folder(spark)}/groma-replay-{uuid.uuid4().hex}"
    once = replay.unique_rows(stream.union(stream), keys=["event_id"], time="at", within="40 days")
    return replay.run_available(once, f"{root}/out", f"{root}/state").select("event_id", "user_id", "event_type")


@query("q182_notices")
def shown_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notices of their user, an hour of theirs as a second."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "buy", "cancelled").otherwise(F.col("event_type"))
    clock = F.unix_micros(F.col("ts").cast("timestamp")) / HOUR
    return notices.notices(table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), clock.alias("clock"), "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("key")))


@query("q194_display_levels", f"""WITH {SEGMENTS}, b AS (SELECT *, clock // {DAY} AS bucket FROM seg), n AS (SELECT *, lead(clock) OVER (PARTITION BY run_id, segment, bucket ORDER BY clock, id) AS following FROM b),
s AS (SELECT *, least(coalesce(following - clock, {6 * HOUR}), {6 * HOUR}, {4 * HOUR}) AS held FROM n), l AS (SELECT run_id, segment, bucket, arg_max({{'v': raw_count}}, (clock, id)).v AS level FROM s GROUP BY ALL),
h AS (SELECT run_id, segment, bucket, l.level, coalesce(sum(held) FILTER (raw_count >= l.level), 0) AS total FROM s JOIN l USING (run_id, segment, bucket) GROUP BY ALL)
SELECT run_id, segment, bucket, level, CASE WHEN level IS NULL THEN 'unknown' WHEN total >= {5 * HOUR} THEN 'confirmed' ELSE 'sampled' END AS basis,
  CASE WHEN level IS NULL OR total < {5 * HOUR} THEN 'unknown' WHEN level > 0 THEN 'present' ELSE 'absent' END AS presence FROM h""")
def display_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.display_levels(segmented(spark, sf_dir), size=DAY, step=6 * HOUR, cap=4 * HOUR, least=5 * HOUR, value="raw_count")


@query("q198_stream_runs", f"WITH {OBS}, g AS (SELECT *, clock - lag(clock) OVER (PARTITION BY run_id ORDER BY clock, id) AS gap FROM obs) SELECT CAST(run_id AS VARCHAR) AS source, CAST(attempt AS BIGINT) AS attempt, count(*) AS samples, min(clock)::DOUBLE AS first, max(clock)::DOUBLE AS last FROM (SELECT *, 1 + sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clock, id) AS attempt FROM g) GROUP BY run_id, attempt")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each source on a stream: timers close them, and every interruption begins another attempt."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    seen = views.as_observations(events).select(F.col("run_id").cast("string").alias("source"), "clock")
    root = f"{shared_folder(spark)}/groma-runs-{uuid.uuid4().hex}"
    versions = monitor.run_available(monitor.runs(seen, quiet=GAP / 1e6, keep=30 * 86_400.0, unit=1e6, delay="1 day"), f"{root}/out", f"{root}/state")
    return monitor.latest(versions, ["source", "attempt"]).select("source", "attempt", "samples", "first", "last")
