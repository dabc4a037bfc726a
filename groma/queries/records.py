"""Labelled records: classes, coverage, edits, matches, splits, samples and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groma.catalogue import DETECTIONS, query
from groma.operators import curation, hamming, joins, records
from groma.sources import views
from groma.sources.views import table

NAMES = {"BRAND": "digger", "ECONOMY": "crane", "PROMO": None, "STANDARD": "truck"}
BITS = "b AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CASE WHEN i = 1 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (64 - i) END ELSE 0 END)) AS BIGINT) AS bits FROM embeddings WHERE len(embedding) >= 64)"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 64).select("vec_id", joins.sign_bits(F.col("embedding")).alias("bits"))


@query("q30_hamming_nearest", f"WITH {BITS}, p AS (SELECT a.vec_id, bit_count(xor(a.bits, c.bits)) AS distance, c.vec_id AS nearest FROM b a JOIN b c ON a.vec_id % 20 = c.vec_id % 20 AND a.vec_id % 3 = 0 AND c.vec_id % 3 <> 0) SELECT vec_id, CAST(min(distance) AS INTEGER) AS distance, arg_min(nearest, (distance, nearest)) AS nearest FROM p GROUP BY vec_id")
def hamming_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns(spark, sf_dir).withColumn("camera", F.col("vec_id") % 20)
    return hamming.nearest(rows.filter("vec_id % 3 = 0"), rows.filter("vec_id % 3 <> 0"), key="vec_id", bits="bits", within="camera")


@query("q36_coverage_shares", "SELECT o_custkey, avg(CASE WHEN hit > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS covered, sum(hit) / sum(n)::DOUBLE AS assigned FROM (SELECT o_custkey, o_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS n, count(DISTINCT CASE WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN l_returnflag || l_linestatus END) AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey")
def coverage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("classes"))
    listed = F.array(*[F.lit(x) for x in ("RF", "RO", "AO", "NO")])
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    hit = F.size(F.array_intersect("classes", listed))
    return joined.groupBy("o_custkey").agg(F.avg(F.arrays_overlap("classes", listed).cast("double")).alias("covered"), (F.sum(hit) / F.sum(F.size("classes"))).alias("assigned"))


@query("q39_validation_errors", f"WITH {DETECTIONS}, e AS (SELECT frame_id, row, concat_ws(',', CASE WHEN x2 > 0.6 THEN 'wide' END, CASE WHEN y1 > 0.4 THEN 'low' END, CASE WHEN class_id NOT IN ('A', 'N') THEN 'class' END) AS errors FROM det) SELECT errors, count(*) AS n, count(DISTINCT frame_id) AS frames, min(row) AS example FROM e WHERE errors <> '' GROUP BY errors")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = F.array(F.when(F.col("box.x2") > 0.6, "wide"), F.when(F.col("box.y1") > 0.4, "low"), F.when(~F.col("class_id").isin("A", "N"), "class"))
    rows = views.detections(spark, sf_dir).select("frame_id", "row", F.array_join(F.array_compact(faults), ",").alias("errors")).filter("errors <> ''")
    return rows.groupBy("errors").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame_id").alias("frames"), F.min("row").alias("example"))


SPLIT = """WITH c AS (SELECT l_partkey AS component, count(*) AS weight, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' ELSE 'N' END AS stratum FROM lineitem GROUP BY 1),
o AS (SELECT *, CAST(('0x' || substr(md5(CAST(component AS VARCHAR)), 1, 13)) AS BIGINT) AS place FROM c),
r AS (SELECT *, sum(weight) OVER (PARTITION BY stratum ORDER BY place, component) - weight / 2.0::DOUBLE AS reached, sum(weight) OVER (PARTITION BY stratum) AS total FROM o)
SELECT component, stratum, weight, CASE WHEN reached / total < 0.75 THEN 'train' WHEN reached / total < 0.9 THEN 'val' ELSE 'test' END AS split FROM r"""


@query("q47_split_assignment", SPLIT)
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = F.when(F.bool_or(F.col("l_returnflag") == "R"), "R").when(F.bool_or(F.col("l_returnflag") == "A"), "A").otherwise("N")
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("component")).agg(F.count(F.lit(1)).alias("weight"), rare.alias("stratum"))
    return records.stratified(parts, component="component", weight="weight", stratum="stratum", shares=[("train", 0.75), ("val", 0.15), ("test", 0.1)])


@query("q80_canonical_classes", "SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'BRAND' THEN 'digger' WHEN 'ECONOMY' THEN 'crane' WHEN 'STANDARD' THEN 'truck' END AS class_id FROM part WHERE split_part(p_type, ' ', 1) IN ('BRAND', 'ECONOMY', 'STANDARD')")
def canonical_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.canonical(F.substring_index("p_type", " ", 1), NAMES).alias("class_id")).filter("class_id is not null")


@query("q81_frequent_classes", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 34)")
def frequent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return records.frequent_classes(lines, kind="l_partkey", record="l_orderkey", least=34)


@query("q82_chosen_records", "SELECT l_orderkey, count(*) AS objects FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'N')")
def chosen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("classes"), F.count(F.lit(1)).alias("objects"))
    return held.filter(records.chosen(F.col("classes"), required=["R"], dropped=["N"])).select("l_orderkey", "objects")


@query("q83_edited_labels", "WITH e AS (SELECT event_id % 2000 AS doc_id, CASE WHEN any_value(event_id % 2000) % 3 = 0 THEN 'drop' ELSE 'set' END AS action, CAST(any_value(event_id % 2000) % 2 AS BIGINT) AS c FROM events WHERE event_type = 'click' GROUP BY 1) SELECT l.doc_id, CAST(quality AS BIGINT) AS before, CASE action WHEN 'drop' THEN NULL WHEN 'set' THEN c ELSE CAST(quality AS BIGINT) END AS after, CASE WHEN action = 'drop' THEN 'dropped' WHEN action = 'set' AND c <> quality THEN 'changed' ELSE 'kept' END AS change FROM labels l LEFT JOIN e USING (doc_id)")
def edited_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    edits = table(spark, sf_dir, "events").filter("event_type = 'click'").select((F.col("event_id") % 2000).alias("doc_id")).distinct()
    edits = edits.select("doc_id", F.when(k % 3 == 0, "drop").otherwise("set").alias("action"), (k % 2).cast("long").alias("class_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("class_id"))
    return records.edited(labels, edits, key=["doc_id"])


@query("q84_matched_in_stages", """WITH r AS (SELECT p_partkey AS right_id, p_name AS k1, p_brand || p_size AS k2, CAST(p_partkey % 1000 AS VARCHAR) AS k3 FROM part), l AS (SELECT p_partkey AS left_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x' END AS k1, p_brand || (p_size + 1) AS k2, CAST(p_partkey % 1000 AS VARCHAR) AS k3 FROM part),
u1 AS (SELECT k1, min(right_id) AS t FROM r GROUP BY 1 HAVING count(*) = 1), u2 AS (SELECT k2, min(right_id) AS t FROM r GROUP BY 1 HAVING count(*) = 1), u3 AS (SELECT k3, min(right_id) AS t FROM r GROUP BY 1 HAVING count(*) = 1)
SELECT left_id, coalesce(u1.t, u2.t, u3.t) AS right_id, CASE WHEN u1.t IS NOT NULL THEN 'k1' WHEN u2.t IS NOT NULL THEN 'k2' ELSE 'k3' END AS stage FROM l LEFT JOIN u1 USING (k1) LEFT JOIN u2 USING (k2) LEFT JOIN u3 USING (k3) WHERE coalesce(u1.t, u2.t, u3.t) IS NOT NULL""")
def matched_in_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k3 = (F.col("p_partkey") % 1000).cast("string").alias("k3")
    right = part.select(F.col("p_partkey").alias("right_id"), F.col("p_name").alias("k1"), F.concat("p_brand", F.col("p_size").cast("string")).alias("k2"), k3)
    left = part.select(F.col("p_partkey").alias("left_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("x").alias("k1"), F.concat("p_brand", (F.col("p_size") + 1).cast("string")).alias("k2"), k3)
    return records.matched_in_stages(left, right, left_id="left_id", right_id="right_id", keys=["k1", "k2", "k3"])


@query("q85_merged_reports", "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) o FULL JOIN (SELECT o_custkey + 40 AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON n.k = o.k")
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy((F.col("o_custkey") + 40).alias("k")).agg(F.max("o_orderpriority").alias("v"))
    return records.merged_reports(old, new, "k")


@query("q86_class_samples", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s7|' || o_orderpriority || '|' || o_orderkey), o_orderkey) <= 12")
def class_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return records.sampled(orders, group="o_orderpriority", record="o_orderkey", most=12, seed="s7")


@query("q87_clock_checks", "SELECT run_id, count(*) AS rows, bool_and(coalesce(step > 0, true)) AS rising, max(step) AS largest FROM (SELECT user_id AS run_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) GROUP BY run_id")
def clock_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.monotone(views.observations(spark, sf_dir), run="run_id", clock="clock", row="id")


@query("q88_manifest_mismatches", "WITH w AS (SELECT o_orderkey AS k, o_orderkey % 7 AS n FROM orders), c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(w.k, c.k) AS k, w.n AS written_n, c.n AS counted_n FROM w FULL JOIN c ON w.k = c.k WHERE w.n IS DISTINCT FROM c.n")
def manifest_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).alias("n"))
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return records.mismatches(written, counted, "k", ["n"])


@query("q89_class_index_audit", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_nationkey % 6)), ',') AS found, len(list_filter([0, 1, 2, 3, 4], lambda x: NOT list_contains(list(DISTINCT n_nationkey % 6), x))) > 0 AS missing, len(list_filter(list(DISTINCT n_nationkey % 6), lambda x: x > 4)) > 0 AS unexpected FROM nation GROUP BY 1")
def class_index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(*[F.lit(i).cast("long") for i in range(5)])
    held = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_set((F.col("n_nationkey") % 6).cast("long"))).alias("f"))
    return held.select("n_regionkey", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("found"), (F.size(F.array_except(expected, "f")) > 0).alias("missing"), (F.size(F.array_except("f", expected)) > 0).alias("unexpected"))


@query("q90_cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3) GROUP BY 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey"))
    return records.without_parents(table(spark, sf_dir, "lineitem").select("l_orderkey"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("q91_group_size_histogram", "SELECT size, count(*) AS groups, CAST(sum(size) AS BIGINT) AS records FROM (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY size")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("records"))


@query("q92_portfolio_totals", "SELECT coalesce(l_returnflag, 'all') AS dataset, count(*) AS objects, count(DISTINCT l_orderkey) AS records, count(DISTINCT l_partkey) AS classes FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by dataset, and of all together: distinct records and classes of the union, not sums."""
    lines = table(spark, sf_dir, "lineitem").rollup("l_returnflag")
    totals = lines.agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("l_orderkey").alias("records"), F.count_distinct("l_partkey").alias("classes"))
    return totals.select(F.coalesce("l_returnflag", F.lit("all")).alias("dataset"), "objects", "records", "classes")


@query("q93_condition_shares", "SELECT l_returnflag, avg(CASE WHEN l_quantity < 10 THEN 1.0::DOUBLE ELSE 0 END) AS small, avg(CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE 0 END) AS dark FROM lineitem GROUP BY 1")
def condition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(share(F.col("l_quantity") < 10).alias("small"), share(F.col("l_discount") == 0).alias("dark"))


@query("q94_contract_rules", "SELECT event_id, CASE WHEN event_type = 'click' THEN value END IS NULL OR event_type = 'click' AS seconds_rule, CASE WHEN event_type = 'error' THEN NULL ELSE value / 200 END IS NULL OR (value / 200 BETWEEN 0 AND 1) AS ratio_rule, (event_type = 'error') = (CASE WHEN event_type = 'error' THEN NULL ELSE value END IS NULL) AS null_rule FROM events")
def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of an evidence window: seconds for dense video only, ratios in [0, 1], a null ratio if and only if no sample is usable."""
    seconds = F.when(F.col("event_type") == "click", F.col("value"))
    ratio = F.when(F.col("event_type") == "error", None).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", (seconds.isNull() | (F.col("event_type") == "click")).alias("seconds_rule"), ((ratio / 200).isNull() | (ratio / 200).between(0, 1)).alias("ratio_rule"), ((F.col("event_type") == "error") == ratio.isNull()).alias("null_rule"))


@query("q95_even_picks", "WITH n AS (SELECT user_id, event_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM n WHERE k IN (0, CAST(floor((n - 1) / 4.0::DOUBLE) AS BIGINT), CAST(floor(2 * (n - 1) / 4.0::DOUBLE) AS BIGINT), CAST(floor(3 * (n - 1) / 4.0::DOUBLE) AS BIGINT), n - 1)")
def even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    placed = table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("k", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("n") - 1) / 4.0))
    return placed.filter(F.array_contains(wanted, F.col("k").cast("long"))).select("user_id", "event_id")


@query("q96_median_picks", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, CASE k WHEN n // 2 THEN 'median' WHEN n // 4 THEN 'lower' ELSE 'upper' END AS place FROM n WHERE k IN (n // 4, n // 2, 3 * n // 4)")
def median_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    placed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("k", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda c: F.floor(c).cast("long")
    k, half, low, high = F.col("k"), at(F.col("n") / 2), at(F.col("n") / 4), at(3 * F.col("n") / 4)
    named = F.when(k == half, "median").when(k == low, "lower").when(k == high, "upper")
    return placed.select("o_custkey", "o_orderkey", named.alias("place")).filter("place is not null")


@query("q97_grid_samples", "SELECT run_id, tick, min(clock) AS clock, arg_min(id, (clock, id)) AS id FROM (SELECT user_id AS run_id, epoch_us(ts) AS clock, event_id AS id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-05')) // 43200000000 AS tick FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') GROUP BY run_id, tick")
def grid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 1704412800 * 1_000_000
    found = records.grid_samples(views.observations(spark, sf_dir), run="run_id", clock="clock", row="id", start=start, step=43_200_000_000, end=start + 15 * 86_400_000_000)
    return found.withColumn("tick", F.col("tick").cast("long"))


@query("q98_looped_replay", "SELECT user_id AS run_id, event_id AS id, CAST(c AS INTEGER) AS cycle, epoch_us(ts) + c * 2592000000000 AS clock FROM events, range(0, 3) AS r(c) WHERE event_type = 'click' AND epoch_us(ts) + c * 2592000000000 < epoch_us(TIMESTAMP '2024-03-15')")
def looped_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording played again until a given time, each cycle a run's length later."""
    rows = views.observations(spark, sf_dir).filter("class_id = 'click'")
    cycles = rows.select("run_id", "id", "clock", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cycle"))
    moved = cycles.withColumn("clock", F.col("clock") + F.col("cycle") * F.lit(2_592_000_000_000))
    return moved.filter(F.col("clock") < 1_710_460_800 * 1_000_000).select("run_id", "id", "cycle", "clock")


_BOTH = "(greatest(0, least(k.x2, x.x2) - greatest(k.x1, x.x1)) * greatest(0, least(k.y2, x.y2) - greatest(k.y1, x.y1)))"
_IOU = f"coalesce({_BOTH} / nullif((k.x2 - k.x1) * (k.y2 - k.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - {_BOTH}, 0), 0)"
DOUBLED = f"""WITH RECURSIVE {DETECTIONS}, n AS (SELECT frame_id, row, class_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY frame_id ORDER BY row, class_id, x1, y1, x2, y2) AS i FROM det),
f AS (SELECT DISTINCT frame_id, 0::BIGINT AS i, CAST([] AS STRUCT(row BIGINT, class_id VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, conflict BOOLEAN)[]) AS kept FROM n
UNION ALL SELECT frame_id, i, CASE WHEN list_contains([k.class_id = x.class_id AND {_IOU} >= 0.9 for k in kept], true) THEN kept
  ELSE list_append(kept, {{'row': x.row, 'class_id': x.class_id, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'conflict': list_contains([k.class_id <> x.class_id AND {_IOU} >= 0.75 for k in kept], true)}}) END
FROM (SELECT n.frame_id, n.i, f.kept, {{'row': n.row, 'class_id': n.class_id, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}} AS x FROM f JOIN n ON n.frame_id = f.frame_id AND n.i = f.i + 1)),
last AS (SELECT frame_id, arg_max(kept, i) AS kept FROM f GROUP BY frame_id)
SELECT frame_id, k.row AS row, k.class_id, k.conflict FROM (SELECT frame_id, unnest(kept) AS k FROM last)"""


@query("q99_doubled_boxes", DOUBLED)
def doubled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.doubled_boxes(views.detections(spark, sf_dir), record="frame_id", kind="class_id", box="box", row="row")


@query("q100_unpivoted_matrix", "SELECT c_custkey, 'type' || i AS project_type FROM customer, range(1, 5) AS r(i) WHERE (c_custkey + i) % 3 = 0")
def unpivoted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of marks as pairs: what XLSX tables of applicability become."""
    marks = table(spark, sf_dir, "customer").select("c_custkey", *[F.when((F.col("c_custkey") + i) % 3 == 0, "v").alias(f"type{i}") for i in range(1, 5)])
    return marks.unpivot("c_custkey", [f"type{i}" for i in range(1, 5)], "project_type", "mark").filter("mark is not null").select("c_custkey", "project_type")


DIVERSE = """WITH RECURSIVE e AS (SELECT vec_id % 25 AS camera, vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings WHERE len(embedding) >= 64),
p AS (SELECT camera, 1 AS place, [min(vec_id)] AS rows, [arg_min(v, vec_id)] AS picks FROM e GROUP BY camera
UNION ALL SELECT camera, place + 1, list_append(rows, w.vec_id), list_append(picks, w.v)
FROM (SELECT p.camera, p.place, any_value(p.rows) AS rows, any_value(p.picks) AS picks,
    arg_min({'vec_id': e.vec_id, 'v': e.v}, (-list_min([list_reduce([0.0::DOUBLE] || [abs(e.v[i] - c[i]) for i in range(1, len(c) + 1)], lambda s, d: s + d) for c in p.picks[-5:]]), e.vec_id)) AS w
  FROM p JOIN e ON e.camera = p.camera AND NOT list_contains(p.rows, e.vec_id) WHERE p.place < 8 GROUP BY p.camera, p.place))
SELECT camera, rows[place] AS vec_id, place::INTEGER AS place FROM p"""


@query("q101_diverse_frames", DIVERSE)
def diverse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 64).select((F.col("vec_id") % 25).alias("camera"), "vec_id", "embedding")
    return curation.diverse_picks(rows, group="camera", row="vec_id", feature="embedding", most=8)


@query("q102_hash_split", "SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(source), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.75 THEN 'train' WHEN CAST(('0x' || substr(md5(source), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.9 THEN 'val' ELSE 'test' END AS split FROM documents WHERE source IS NOT NULL")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    return docs.select("doc_id", curation.split_of(F.col("source"), [("train", 0.75), ("val", 0.15), ("test", 0.1)]).alias("split"))
