"""Frame evaluation, tracks, raw detections and bindings, on small made-up cases."""

import pytest
from pyspark.sql import functions as F

from groma.functions import geometry, text
from groma.operators import boxes, frames, joins, paging, records, series
from groma.plans import versions
from groma.streaming.tracks import Tracker, tracks

SQUARE = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
LEFT = [{"x": 0.0, "y": 0.0}, {"x": 0.5, "y": 0.0}, {"x": 0.5, "y": 1.0}, {"x": 0.0, "y": 1.0}]


def evaluated(spark, *, boxes_seen, usable=True, supported=("1", "4"), visible=True, needs=((10, "1", 2),), works=((10, 0, 5, False),), bound=((10, "all"),)):
    box = lambda x: {"x1": x, "y1": 0.2, "x2": x + 0.1, "y2": 0.6}
    found = frames.evaluate(
        spark.createDataFrame([(1, 7, 3, usable, list(supported))], "frame_id long, plan_id long, at int, usable boolean, supported array<string>"),
        spark.createDataFrame([(1, c, box(x), a, o) for c, x, a, o in boxes_seen], "frame_id long, class_id string, box struct<x1:double,y1:double,x2:double,y2:double>, activity string, observed boolean"),
        spark.createDataFrame([(7, *w) for w in works], "plan_id long, work_id long, starts int, ends int, done boolean"),
        spark.createDataFrame(list(needs), "work_id long, class_id string, need int"),
        spark.createDataFrame([("all", SQUARE, visible), ("left", LEFT, visible)], "region_id string, polygon array<struct<x:double,y:double>>, visible boolean"),
        spark.createDataFrame(list(bound), "work_id long, region_id string"),
        width=5,
    )
    return {(r.region_id, r.work_id): r for r in found.collect()}


def test_unknown_is_not_zero(spark):
    one = [("1", 0.1, "idle", True), ("1", 0.3, "idle", False)]
    got = evaluated(spark, boxes_seen=one, needs=((10, "1", 3),))["all", 10]
    assert (got.readiness, got.missing, got.needed, got.n_idle) == ("ready", 1, 3, 1) and abs(got.missing_ratio - 1 / 3) < 1e-9
    for hidden in ({"usable": False}, {"visible": False}, {"supported": ["4"]}):
        got = evaluated(spark, boxes_seen=one, **hidden)["all", 10]
        assert (got.readiness, got.missing, got.missing_ratio, got.excess) == ("insufficient_evidence", None, None, 0)
    assert evaluated(spark, boxes_seen=[])["all", 10].missing == 2
    assert evaluated(spark, boxes_seen=one, works=((10, 4, 9, False),)) == {} == evaluated(spark, boxes_seen=one, works=((10, 0, 3, False),))
    assert evaluated(spark, boxes_seen=one, works=((10, 0, 5, True),)) == {}


def test_excess_unless_another_work_explains_it(spark):
    seen = [("1", 0.1, "working", True), ("1", 0.7, "working", True), ("1", 0.2, "working", True)]
    needs = ((10, "1", 1), (11, "1", 1))
    assert evaluated(spark, boxes_seen=seen, needs=needs)["all", 10].excess == 2
    both = {"needs": needs, "works": ((10, 0, 5, False), (11, 0, 5, False)), "bound": ((10, "all"), (11, "left"))}
    got = evaluated(spark, boxes_seen=seen, **both)
    assert got["all", 10].excess == 0 and got["left", 11].excess == 0
    # the other work's zone holds none of them
    got = evaluated(spark, boxes_seen=seen[1:2] * 3, **both)
    assert got["all", 10].excess == 2 and got["left", 11].missing == 1


def box(x, kind="1", score=0.9):
    return kind, score, (x, 0.2, x + 0.2, 0.7)


@pytest.mark.parametrize("hits", [1, 2, 3, 4])
def test_tracks_are_held_for_three_frames_after_four_hits(hits):
    tracker = Tracker()
    for t in range(hits):
        (_, first, observed), = tracker.update(t, [box(0.2)])
        assert observed
    for missed in range(1, 5):
        held = tracker.update(hits - 1 + missed, [])
        assert [(t.number, o) for _, t, o in held] == ([(first.number, False)] if hits == 4 and missed <= 3 else [])


def test_weak_boxes_keep_a_track_but_confirm_nothing():
    tracker = Tracker()
    for t in range(4):
        (_, first, _), = tracker.update(t, [box(0.2)])
    assert [[o for *_, o in tracker.update(t, [box(0.2, score=0.2)])] for t in range(4, 8)] == [[False]] * 3 + [[]]
    (_, again, _), = tracker.update(8, [box(0.2)])
    assert again.number == first.number and tracker.update(9, []) == []


def test_another_class_in_the_same_place_revokes_a_track():
    tracker = Tracker()
    for t in range(4):
        tracker.update(t, [box(0.2)])
    assert [(t.kind, o) for _, t, o in tracker.update(4, [box(0.2, "4")])] == [("4", True)]
    assert tracker.update(5, []) == []
    tracker = Tracker()
    for t in range(4):
        tracker.update(t, [box(0.2)])
    assert [(t.kind, o) for _, t, o in tracker.update(4, [box(0.7, "4")])] == [("4", True), ("1", False)]


def test_a_clock_that_jumps_begins_anew(spark):
    rows = [(1, float(t), t, "1", 0.9, 0.2, 0.2, 0.4, 0.7) for t in (0, 1, 2, 3)] + [(1, 10.0, 10, "1", 0.9, 0.2, 0.2, 0.4, 0.7), (1, 11.0, None, None, None, None, None, None, None)]
    rows += [(2, t / 2, 100 + t, "1", 0.9, 0.018 * t, 0.2, 0.018 * t + 0.2, 0.7) for t in range(5)]
    df = spark.createDataFrame(rows, "run_id long, clock double, row long, class_id string, score double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.run_id, r.clock): r for r in tracks(df, max_interframe=1.75).collect()}
    assert len({got[1, float(t)].track_id for t in range(4)}) == 1 and got[1, 10.0].track_id != got[1, 3.0].track_id and (1, 11.0) not in got
    assert [got[2, t / 2].motion for t in range(5)] == ["unknown", "unknown", "stationary", "stationary", "moving"]
    assert (1, 4.0) not in got and got[1, 3.0].motion == "stationary"


def test_raw_detections(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.7], [0.0, 140.0, 320.0, 320.0])], "s array<double>, p array<double>")
    got = df.select(boxes.best_class(F.col("s"), ["a", "b", "c"], least=0.35).alias("c"), boxes.best_class(F.col("s"), ["a", "b", "c"], least=0.8).alias("n"), boxes.unletterboxed(F.col("p"), width=1920, height=1080, side=640).alias("b")).first()
    assert got.c.class_id == "b" and got.n is None and [round(v, 6) for v in got.b] == [0.0, 0.0, 0.5, 0.5]
    t = spark.range(1).select(boxes.tiles(F.lit(1000), F.lit(500), side=640, step=480).alias("t")).first().t
    assert [(x.x1, x.y1, x.x2, x.y2) for x in t] == [(0, 0, 640, 500), (360, 0, 1000, 500)]


def test_seams_are_merged_at_edges_only(spark):
    rows = [(1, "1", 0.9, 1, 0, True, (0.1, 0.1, 0.5, 0.5)), (1, "1", 0.8, 2, 1, True, (0.3, 0.1, 0.52, 0.5)), (1, "1", 0.7, 3, 0, True, (0.1, 0.1, 0.5, 0.5)), (1, "1", 0.6, 4, 1, False, (0.1, 0.1, 0.5, 0.5)), (1, "2", 0.5, 5, 1, True, (0.1, 0.1, 0.5, 0.5))]
    df = spark.createDataFrame([(*r[:6], dict(zip(("x1", "y1", "x2", "y2"), r[6], strict=True))) for r in rows], "frame int, kind string, score double, row int, tile int, edge boolean, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = {r.row: r for r in boxes.merged_over_seams(df, frame="frame", kind="kind", box="box", score="score", row="row", tile="tile", at_edge="edge", least=0.55).collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].parts == 2 and got[1].box.x2 == 0.52
    double = {r.row: r.conflict for r in records.doubled_boxes(df, record="frame", kind="kind", box="box", row="row").collect()}
    assert double == {1: False, 2: False, 5: True}


def test_fixed_polygons_are_inside_alike(spark):
    points = [(0.1, 0.1), (0.7, 0.15), (0.4, 0.3), (0.2, 0.6)]
    polygon = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
    grid = spark.range(41 * 41).select((F.col("id") % 41 / 50).alias("x"), (F.floor(F.col("id") / 41) / 50).alias("y"))
    both = grid.select(geometry.inside(F.struct("x", "y"), polygon).alias("a"), geometry.inside_fixed(F.col("x"), F.col("y"), points).alias("b"))
    assert both.filter("a <> b").count() == 0 and 0 < both.filter("a").count() < 41 * 41


def test_plan_versions_and_bindings(spark):
    requests = spark.createDataFrame([(1, 2), (1, 1), (2, 0), (2, None)], "plan_id long, base int")
    known = spark.createDataFrame([(1, 1), (1, 2)], "plan_id long, version int")
    assert sorted((r.plan_id, str(r.base), r.outcome, r.version) for r in versions.published(requests, known).collect()) == [(1, "1", "conflict", None), (1, "2", "published", 3), (2, "0", "published", 1), (2, "None", "conflict", None)]
    regions = spark.createDataFrame([(1, "a", [1, 9]), (1, "b", [9]), (2, "c", [9])], "source_id long, region_id string, work_ids array<int>")
    works = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "source_id long, plan_works array<int>")
    assert sorted((r.source_id, str(r.region_id), r.work_ids) for r in versions.rebound(regions, works).collect()) == [(1, "None", [2, 3]), (1, "a", [1]), (2, "None", [4])]
    days = spark.createDataFrame([("planned", 5), ("planned", 15), ("planned", 25), ("in_progress", 5), ("completed", 25)], "status string, now int")
    assert [r[0] for r in days.select(versions.phase(F.col("status"), F.lit(10), F.lit(20), F.col("now"))).collect()] == ["upcoming", "active", "overdue", "active", "completed"]


def test_texts(spark):
    df = spark.createDataFrame([("cam7_20240105_101112.jpg",), ("north-gate-2024-01-05-10-11-12.png",), ("thumbs.db",), ("cam_20241305_101112.jpg",)], "n string")
    got = [r.f for r in df.select(text.camera_and_time(F.col("n")).alias("f")).collect()]
    assert [f and (f.camera, str(f.time)) for f in got] == [("cam7", "2024-01-05 10:11:12"), ("north-gate", "2024-01-05 10:11:12"), None, ("cam", "None")]
    assert spark.range(1).select(text.plain_text(F.lit("<p>a &lt;b&gt;</p>\n c&amp;lt;"))).first()[0] == "a <b> c&lt;"


def test_samples_drift_with_their_frames():
    sampler = series.Sampler(1.0)
    assert [t for t in (0.0, 0.5, 1.2, 1.9, 2.1, 2.2, 3.2) if sampler.step(t)[0]] == [0.0, 1.2, 2.2, 3.2]


def test_nearest_in_time_and_pages(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 16), (3, "k", 15), (4, "z", 1), (5, "k", 99)], "id int, key string, t int")
    right = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b")], "key string, t int, v string")
    got = {r.id: (r.near_at, r.near_value) for r in joins.nearest_in_time(left, right, key="key", at="t", value="v").collect()}
    assert got == {1: (10, "a"), 2: (20, "b"), 3: (10, "a"), 4: (None, None), 5: (20, "b")}
    page = paging.offset_page(spark.range(10), ["id"], size=4, offset=4).collect()
    assert [(r.id, r.next_offset) for r in page] == [(4, 8), (5, 8), (6, 8), (7, 8)]
    assert {r.next_offset for r in paging.offset_page(spark.range(10), ["id"], size=4, offset=8).collect()} == {None}


def test_components_stay_whole_and_strata_are_shared_out(spark):
    parts = spark.range(3000).select("id", (1 + F.col("id") % 5).alias("weight"), (F.col("id") % 3).alias("stratum"))
    got = records.stratified(parts, component="id", weight="weight", stratum="stratum", shares=[("train", 0.75), ("val", 0.15), ("test", 0.1)])
    assert got.count() == 3000
    shares = got.groupBy("stratum").pivot("split").sum("weight").collect()
    assert all(abs(r.train / (r.train + r.val + r.test) - 0.75) < 0.01 and abs(r.val / (r.train + r.val + r.test) - 0.15) < 0.01 for r in shares)


def test_plan_files_of_both_encodings(spark, tmp_path):
    from groma.sources.files import plan_rows

    names = {"code": ["Код", "code"], "title": ["Работа"], "starts_at": ["Начало"], "ends_at": ["Конец"]}
    for name, encoding, sep in (("a", "utf-8-sig", ";"), ("b", "cp1251", ",")):
        rows = [["Код", "Работа", "Начало", "Конец", "Кран"], ["1.2", "Котлован", "01.02.2026 08:00", "03.02.2026 08:00", "2"], ["x", "Плохая", "01.02.2026 08:00", "01.01.2026 08:00", "много"], ["1.3", '"две\nстроки"', "2026-02-01T08:00:00", "2026-02-02T08:00:00", ""]]
        (tmp_path / f"{name}.csv").write_bytes("\n".join(sep.join(r) for r in rows).encode(encoding))
        got = plan_rows(spark, f"{tmp_path}/{name}.csv", headers=names, classes={"Кран": "7"}, zone="Europe/Moscow").orderBy("row").collect()
        assert [(r.row, r.code, r.title, r.errors) for r in got] == [(2, "1.2", "Котлован", []), (3, "x", "Плохая", ["code", "period", "Кран"]), (4, "1.3", "две\nстроки", [])]
        assert str(got[0].starts_at) == "2026-02-01 05:00:00" and got[0].resources == {"7": 2} and got[2].resources == {"7": 0}


def test_coco_files(spark, tmp_path):
    import json

    from groma.sources import images

    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "x.jpg", "width": 100, "height": 50}], "categories": [{"id": 3, "name": "crane"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 20]}, {"id": 2, "image_id": 1, "category_id": 3, "bbox": [90, 0, 50, 10]}, {"id": 3, "image_id": 9, "category_id": 3, "bbox": [0, 0, 1, 1]}, {"id": 4, "image_id": 1, "category_id": 3, "bbox": [100, 0, 5, 5]}]}))
    got = {r.annotation_id: r for r in images.coco_boxes(spark, str(tmp_path)).collect()}
    assert [got[i].valid for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert (got[1].name, got[1].kind, got[1].x, got[1].y, got[1].w, got[1].h) == ("x.jpg", "crane", 0.2, 0.4, 0.2, 0.4) and got[2].w == 0.1
    assert [r.path for r in images.listed_files(spark, str(tmp_path)).collect()][0].endswith("a.json")
    stems = spark.createDataFrame([("a_jpg.rf.0123456789abcdef",), ("b_png",), ("c",)], "s string")
    assert [r[0] for r in stems.select(images.stem_without_version(F.col("s"))).collect()] == ["a", "b", "c"]


def test_diverse_picks(spark):
    from groma.operators.curation import diverse_picks

    rows = [("a", i, [float(x), 0.0]) for i, x in enumerate((0, 1, 9, 10, 5))] + [("b", 7, [1.0, 1.0])]
    got = {}
    for r in diverse_picks(spark.createDataFrame(rows, "camera string, frame int, v array<double>"), group="camera", row="frame", feature="v", most=3).orderBy("camera", "place").collect():
        got.setdefault(r.camera, []).append(r.frame)
    assert got == {"a": [0, 3, 4], "b": [7]}


def test_notices_are_gathered_and_urgent_ones_come_first(spark):
    from groma.streaming.notices import Queue, notices

    shown = lambda groups: [(g.kind, len(g.keys)) for g in groups]
    queue = Queue()
    assert shown(queue.take(0, "ready", "a")) == [("ready", 1)] == shown(queue.take(1, "ready", "a"))
    assert shown(queue.take(1, "ready", "b")) == [("ready", 2)]
    queue.take(2, "saved", "c")
    assert shown(queue.take(3, "started", "d")) == [("ready", 2), ("saved", 1), ("started", 1)]
    assert shown(queue.take(4, "failed", "e")) == [("saved", 1), ("started", 1), ("failed", 1)]
    # the one that made room has been shown since 0 and is gone at 7; the others follow, the urgent one last
    assert shown(queue.take(7.5, "saved", "f")) == [("saved", 2), ("started", 1), ("failed", 1)]
    assert shown(queue.take(11, "ready", "g")) == [("failed", 1), ("ready", 1)]
    assert shown(queue.take(16, "ready", "h")) == [("ready", 2)]
    rows = [(u, float(t), t, k, str(t)) for u in (1, 2) for t, k in ((0, "ready"), (1, "failed"), (2, "ready"))]
    got = {(r.user_id, r.event_id): r.shown for r in notices(spark.createDataFrame(rows, "user_id long, clock double, event_id long, kind string, key string")).collect()}
    assert got == {(u, t): s for u in (1, 2) for t, s in ((0, "ready:1"), (1, "ready:1,failed:1"), (2, "ready:2,failed:1"))}


def test_zip_archives(spark, tmp_path):
    import zipfile

    from groma.sources import images

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.jpg", "22")
        z.writestr("a.jpg", "1")
        z.mkdir("empty")
    (tmp_path / "damaged.zip").write_bytes(b"PK no archive")
    found = images.zip_entries(spark, str(tmp_path)).orderBy("entry").collect()
    assert [(r.entry, r.name, r.size) for r in found if not r.error] == [(0, "a.jpg", 1), (1, "b.jpg", 2)]
    assert [(r.path.rsplit("/", 1)[1], r.entry, r.name) for r in found if r.error] == [("damaged.zip", None, None)]
