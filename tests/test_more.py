"""Nearest patterns, splits, picks, reports, maps, pictures, data sets rebuilt, projections: vectors and brute force."""

import csv
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from groma.functions import maps, pictures, text
from groma.operators import curation, hamming, joins, paging, projections, rebuild, reports, splits


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("kind", ["random", "clustered", "narrow"])
def test_nearest_patterns_by_hand(spark, kind, monkeypatch):
    monkeypatch.setattr(hamming, "SMALL", 0)
    rng = random.Random(kind)
    centres = [rng.getrandbits(64) for _ in range(20)]

    def pattern():
        if kind == "random":
            return rng.getrandbits(64)
        if kind == "narrow":
            return rng.getrandbits(6)
        return rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))

    left = [(i, f"c{i % 3}", signed(pattern()) if i else None) for i in range(150)] + [(900, "nowhere", 5)]
    right = [(1000 + i, f"c{i % 2 if i % 50 else 2}", signed(pattern())) for i in range(800)] + [(5, "c0", left[3][2])]
    schema = "key long, camera string, bits long"
    got = {r.key: (r.distance, r.nearest) for r in hamming.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), key="key", bits="bits", within="camera").collect()}
    want = {k: min(((b ^ x) & (1 << 64) - 1).bit_count() * 10**6 + r for r, c, x in right if c == camera) for k, camera, b in left if b is not None and camera != "nowhere"}
    assert got == {k: divmod(v, 10**6) for k, v in want.items()}


def test_few_patterns_are_compared(spark):
    """A hundred thousand patterns, of which the asked ones have a near one: at most a twentieth of all pairs is met, and all are right."""
    rng = np.random.default_rng(3)
    held = rng.integers(-(2**63), 2**63, 100_000)
    asked = [(int(held[i] ^ (1 << int(a)) ^ (1 << int(b))), int(held[i])) for i, a, b in zip(rng.integers(0, 100_000, 200), rng.integers(0, 62, 200), rng.integers(0, 62, 200), strict=True)]
    right = spark.createDataFrame([("g", int(x), i) for i, x in enumerate(held.tolist())], "g string, bits long, to long")
    left = spark.createDataFrame([("g", a) for a in {a for a, _ in asked}], "g string, bits long")
    got = hamming.nearest_patterns(left, right, within="g").collect()
    near = dict(asked)
    assert all(r.distance <= 2 and held[r.to] == near[r.bits] for r in got) and len(got) == len(near)
    assert sum(r.compared for r in got) <= 0.05 * len(held) * len(got)


def test_far_patterns_are_compared_once_with_their_group(spark, monkeypatch):
    """Random patterns, none of them near: after a first look-up each meets its group once, in blocks, and no further round makes work or plans."""
    monkeypatch.setattr(hamming, "BLOCK", 700)
    rng = np.random.default_rng(5)
    held = {g: np.unique(rng.integers(-(2**63), 2**63, 3000)) for g in ("g", "h")}
    asked = {g: np.unique(rng.integers(-(2**63), 2**63, 900)) for g in ("g", "h")}
    right = spark.createDataFrame([(g, int(x), f"n{i:05}") for g in held for i, x in enumerate(held[g].tolist())], "g string, bits long, to string")
    left = spark.createDataFrame([(g, int(x)) for g in asked for x in asked[g].tolist()], "g string, bits long")
    got = {(r.g, r.bits): r for r in hamming.nearest_patterns(left, right, within="g").collect()}
    for g in held:
        apart = np.bitwise_count(asked[g].view(np.uint64)[:, None] ^ held[g].view(np.uint64)[None, :])
        want = {(g, int(x)): (int(apart[i].min()), f"n{apart[i].argmin():05}") for i, x in enumerate(asked[g].tolist())}
        assert want == {k: (r.distance, r.to) for k, r in got.items() if k[0] == g}
    assert max(r.compared for r in got.values()) <= 1.1 * 3000


def test_tables_of_patterns_are_not_broadcast(spark, monkeypatch):
    """They grow with the input; the driver would hold them whole."""
    monkeypatch.setattr(hamming, "LOOKUP", 1)
    monkeypatch.setattr(hamming, "SMALL", 0)
    plans, written = [], hamming.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(hamming, "written", lambda df, name: written(plan(df), name))
    rng = np.random.default_rng(6)
    held = spark.createDataFrame([(i, "c", int(x)) for i, x in enumerate(rng.integers(-(2**63), 2**63, 500))], "key long, camera string, bits long")
    asked = held.filter("key % 50 = 0")
    got = plan(hamming.nearest(asked, held, key="key", bits="bits", within="camera")).collect()
    assert [(r.distance, r.nearest) for r in got] == [(0, r.key) for r in got] and len(got) == 10
    keys = [k for p in plans for k in re.findall(r"BroadcastHashJoin \[(.*?)\], \[", p)]
    assert keys and not [k for k in keys if re.search("bits|value|_own", k)]


def test_nearest_keys_by_several_rounds_of_looking_up(spark, monkeypatch):
    """Where looking up costs nothing, the rounds go on; what is flipped in them is read from a table, however many there are."""
    monkeypatch.setattr(hamming, "LOOKUP", 1)
    monkeypatch.setattr(hamming, "SMALL", 0)
    rounds, flips = [], hamming.flips
    monkeypatch.setattr(hamming, "flips", lambda spark, cuts, s: rounds.append(s) or flips(spark, cuts, s))
    rng = random.Random(8)
    held = [(1000 + i, "c", signed(rng.getrandbits(64))) for i in range(2000)]
    asked = [(i, "c", signed((held[i][2] & (1 << 64) - 1) ^ sum(1 << b for b in rng.sample(range(64), i % 13)))) for i in range(60)]
    schema = "key long, camera string, bits long"
    got = {r.key: (r.distance, r.nearest) for r in hamming.nearest(spark.createDataFrame(asked, schema), spark.createDataFrame(held, schema), key="key", bits="bits", within="camera").collect()}
    assert got == {k: min((((b ^ x) & (1 << 64) - 1).bit_count(), r) for r, _, x in held) for k, _, b in asked}
    assert max(rounds) >= 1


def test_an_empty_side_has_no_nearest(spark):
    none = spark.createDataFrame([], "key long, camera string, bits long")
    one = spark.createDataFrame([(1, "a", 3)], "key long, camera string, bits long")
    assert hamming.nearest(none, one, key="key", bits="bits", within="camera").count() == 0
    assert hamming.nearest(one, none, key="key", bits="bits", within="camera").count() == 0


def test_splits_without_moves_are_counted_once(spark, monkeypatch):
    """What splits hold of the classes is one table, not one for each class and split, as long as nothing moves."""
    names, own = [], splits.written
    monkeypatch.setattr(splits, "written", lambda df, name: names.append(name) or own(df, name))
    rows = [(i, f"k{j}", 1 + (i + j) % 3, 20) for i in range(300) for j in range(4) if (i + j) % 2]
    counts = spark.createDataFrame(rows, "component long, class_id string, n long, weight long")
    found = splits.assigned(counts, shares=[("train", 0.75), ("val", 0.15), ("test", 0.1)]).collect()
    assert len(found) == len({r.component for r in found}) == 300
    assert names.count("held") == 1


def test_every_split_has_every_class_and_its_share(spark):
    rng = random.Random(8)
    rows, sizes = [], {}
    for c in range(600):
        weight = rng.randrange(1, 9)
        sizes[c] = weight
        held = {k for k, p in (("common", 0.8), ("usual", 0.3), ("rare", 0.01)) if rng.random() < p}
        rows += [(c, k, rng.randrange(1, weight + 1), weight) for k in held] or [(c, None, None, weight)]
    rows = [r for r in rows if r[1] != "rare"] + [(c, "rare", 1, sizes[c]) for c in (11, 12, 13)]
    df = spark.createDataFrame(rows, "component long, class_id string, n long, weight long")
    found = splits.assigned(df, shares=[("train", 0.75), ("val", 0.15), ("test", 0.1)]).collect()
    of = {r.component: r.split for r in found}
    assert set(of) == {r[0] for r in rows} and len(found) == len(of)
    total = {}
    for c, k, n, _ in rows:
        if k:
            total.setdefault(k, {}).setdefault(of[c], 0)
            total[k][of[c]] += n
    assert all(set(t) == {"train", "val", "test"} for t in total.values())
    share = lambda t, s: t.get(s, 0) / sum(t.values())
    for k in ("common", "usual"):
        assert abs(share(total[k], "train") - 0.75) < 0.06 and abs(share(total[k], "val") - 0.15) < 0.05 and abs(share(total[k], "test") - 0.1) < 0.05
    records = {}
    for c, s in of.items():
        records[s] = records.get(s, 0) + sizes[c]
    assert abs(share(records, "train") - 0.75) < 0.08
    again = splits.assigned(df.repartition(7), shares=[("train", 0.75), ("val", 0.15), ("test", 0.1)]).collect()
    assert {r.component: r.split for r in again} == of
    assert splits.assigned(df.filter("false"), shares=[("train", 0.75), ("val", 0.25)]).count() == 0


def test_diverse_picks_by_hand(spark):
    rng = random.Random(6)
    rows = [(g, i, [float(rng.randrange(30)) for _ in range(3)]) for g in ("a", "b") for i in range(40 if g == "a" else 4)]
    df = spark.createDataFrame(rows, "camera string, frame int, v array<double>")
    got = {}
    for r in curation.diverse_picks(df, group="camera", row="frame", feature="v", most=9).orderBy("camera", "place").collect():
        got.setdefault(r.camera, []).append(r.frame)
    for g, picks in got.items():
        x = {i: np.array(v) for c, i, v in rows if c == g}
        want = [min(x)]
        while len(want) < min(9, len(x)):
            away = {i: min(np.abs(v - x[c]).sum() for c in want[-5:]) for i, v in x.items() if i not in want}
            want.append(min(away, key=lambda i: (-away[i], i)))
        assert picks == want


def test_pictures_against_numpy(spark):
    rng = np.random.default_rng(5)
    grey = rng.integers(0, 256, (6, 32, 32)).astype(float)
    rgb = rng.integers(0, 256, (6, 3, 1024))
    rgb[0, :, :50] = 0
    df = spark.createDataFrame([(i, g.ravel().tolist(), *[[int(v) for v in c] for c in rgb[i]]) for i, g in enumerate(grey)], "i int, g array<double>, r array<int>, s array<int>, b array<int>")
    got = df.select("i", pictures.brightness(F.col("g")).alias("m"), pictures.contrast(F.col("g")).alias("c"), pictures.edge_energy(F.col("g"), 32, 32).alias("e"), pictures.saturation(F.col("r"), F.col("s"), F.col("b")).alias("s"), pictures.cosine_block(F.col("g")).alias("d"), pictures.cosine_hash(F.col("g")).alias("h")).collect()
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    m = np.sqrt(np.where(k == 0, 1, 2) / 32) * np.cos(np.pi * (2 * n + 1) * k / 64)
    for r in got:
        g, c = grey[r.i], rgb[r.i].astype(float)
        assert np.allclose([r.m, r.c], [g.mean(), g.std()], atol=1e-9)
        assert np.isclose(r.e, (np.abs(np.diff(g, axis=0)).mean() + np.abs(np.diff(g, axis=1)).mean()) / 2, atol=1e-9)
        top, low = c.max(0), c.min(0)
        assert np.isclose(r.s, np.where(top > 0, (top - low) / np.maximum(top, 1e-12), 0).mean(), atol=1e-9)
        block = (m @ g @ m.T)[:8, :8]
        assert np.allclose(r.d, block.ravel(), atol=1e-9)
        bits = (block > np.median(block[1:])).ravel()
        assert r.h == signed(int("".join("1" if x else "0" for x in bits), 2))


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "gone": "x", "n": None}, {"a": "1", "b": "3", "new": None, "n": None}, '{"p": {"q": {"r": 1}, "s": [1, {"t": 2}]}, "u": "v", "w": {}}')], "x map<string,string>, y map<string,string>, j string")
    r = df.select(maps.changed_entries(F.col("x"), F.col("y")).alias("c"), maps.removed_keys(F.col("x"), F.col("y")).alias("g"), maps.by_path(F.col("j")).alias("p"), maps.added_items(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(2), F.lit(4))).alias("n")).first()
    assert {k: (v.before, v.after) for k, v in r.c.items()} == {"b": ("2", "3"), "new": (None, None)} and r.g == ["gone"] and r.n == [3, 4]
    assert r.p == {"p.q.r": "1", "p.s": '[1,{"t":2}]', "u": "v", "w": "{}"}
    kinds = "kind string, e map<string,int>, c map<string,int>, f array<struct<class_id:string,count:bigint>>"
    rows = [("missing", {"0": 2, "1": 1, "9": 4}, {"0": 0, "1": 3}, None), ("excess", {"0": 1}, {"0": 5, "3": 2}, [("3", 2)]), ("idle", None, None, [("4", 1)])]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, kinds).select(maps.counted_classes(F.col("kind"), F.col("e"), F.col("c"), F.col("f"))).collect()]
    assert got == [[("0", 2, 0, 2, 0, 0)], [("3", 0, 2, 0, 2, 2)], [("4", 0, None, None, None, 1)]]


def test_names_and_messages(spark):
    space = "12345678-9abc-4def-8123-456789abcdef"
    df = spark.createDataFrame([(f"7:{n}",) for n in ("a", "é", "", "worker/1")], "n string")
    assert all(r.u == str(uuid.uuid5(uuid.UUID(space), r.n)) for r in df.select("n", text.name_uuid(space, F.col("n")).alias("u")).collect())
    rows = [("Техника сверх плана", None, 3), ("Сверх плана 2 ед. техники", "excess", None), ("x", "excess", 0), ("Количество превышает план; параллельные работы не объясняют избыток!", "missing", None), ("other", None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, k string, n int").select(text.shown_message(F.col("m"), F.col("k"), F.col("n"))).collect()]
    assert got == ["Сверх плана 3 ед. техники", "Сверх плана 2 ед. техники", "Обнаружена техника сверх плана", "Обнаружена техника сверх плана!", "other"]
    steps = F.array(*[F.lit(float(x)) for x in (30, 60, 300)])
    found = spark.createDataFrame([(5.0,), (6.0,), (49.0,), (900.0,), (None,), (float("nan"),), (float("inf"),), (-1.0,)], "s double").select(text.default_step(F.col("s"), steps)).collect()
    assert [r[0] for r in found] == [30.0, 60.0, 300.0, 300.0, 30.0, 30.0, 30.0, 30.0]


def test_an_event_report_as_a_file(spark, tmp_path):
    schema = "id long, source_id long, work_id long, plan_id long, status string, first_seen timestamp, last_seen timestamp, message string, code string, title string, work_starts_at timestamp, work_ends_at timestamp, notified_at timestamp, expected map<string,int>, counts map<string,int>, suppressed boolean, confirmed boolean"
    from datetime import datetime as at

    t, u = at(2026, 9, 28, 6), at(2026, 9, 28, 7, 30)
    rows = [
        (2, 1, 5, 1, "resolved", u, u, "too few; =really", None, None, None, None, t, {"0": 2, "16": 0}, {"0": None, "1": 3}, None, None),
        (1, 9, 6, 1, "open", t, u, "=more", "1.1", "-own", t, u, None, {"0": 1}, None, False, True),
        (3, 1, 5, 1, "unknown", t, u, "x", None, None, None, None, None, {"77": 1}, None, False, True),
        (4, 1, 5, 1, "open", t, u, "x", None, None, None, None, None, None, None, True, True),
        (5, 1, 5, 1, "open", t, u, "x", None, None, None, None, None, None, None, False, False),
        (6, 1, 5, 1, "open", t, u, "", None, None, None, None, None, None, None, False, True),
    ]
    works = spark.createDataFrame([(1, 5, "2.1", "stage", t, u)], "plan_id long, work_id long, code string, title string, starts_at timestamp, ends_at timestamp")
    sources = spark.createDataFrame([(1, "gate")], "source_id long, name string")
    found = reports.event_rows(spark.createDataFrame(rows, schema), works=works, sources=sources, project="site", begins=F.lit(t), ends=F.lit(None).cast("timestamp"), zone="Europe/Moscow", names={"0": "digger"})
    reports.write_table(found, str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("*.csv")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf" + "Объект;".encode())
    head, *lines = list(csv.reader(raw.decode("utf-8-sig").splitlines(), delimiter=";"))
    assert head == [*reports.EVENT_COLUMNS, "digger: план", "digger: на кадре", "Класс 1: план", "Класс 1: на кадре", "Класс 16: план", "Класс 16: на кадре"]
    local = lambda h: f"28.09.2026 {h}:00"
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone == "UTC":
        assert lines[0] == ["site", local("09:00"), "", "1.1", "'-own", local("09:00"), local("10:30"), local("09:00"), "", local("10:30"), "", "", "'=more", "1", "", "", "", "", ""]
        assert lines[1] == ["site", local("09:00"), "", "2.1", "stage", local("09:00"), local("10:30"), local("10:30"), local("10:30"), local("10:30"), local("09:00"), "gate", "too few; =really", "2", "", "", "3", "0", ""]
    assert len(lines) == 2


def test_a_plan_table_keeps_classes_of_then_and_now(spark):
    rows = spark.createDataFrame([("2.10", "b", "2026-01-10 09:00:00", {"7": 1}), ("2.9", "a", "2026-07-10 09:00:00", {"0": 2, "x": 1})], "code string, title string, s string, resources map<string,int>").select("code", "title", F.col("s").cast("timestamp").alias("starts_at"), F.col("s").cast("timestamp").alias("ends_at"), "resources")
    found = reports.plan_table(rows, current=["0", "10"], names={"0": "digger", "10": "crane"}, zone="Europe/Berlin")
    assert found.columns == [*reports.PLAN_COLUMNS, "digger", "Класс 7", "crane", "Класс x"]
    got = [tuple(r) for r in found.collect()]
    assert [r[0] for r in got] == ["2.9", "2.10"] and [r[4:] for r in got] == [(2, 0, 0, 1), (0, 1, 0, 0)]
    assert got[0][2].endswith("+02:00") and got[1][2].endswith("+01:00")
    assert reports.plan_template(rows, current=["0"], names={"0": "digger"}).columns == [*reports.PLAN_COLUMNS, "digger"]


def test_a_rebuilt_set(spark):
    box = lambda k: (k, 0.1, 0.2, 0.3, 0.4)
    rows = [("c.jpg", "g/1", [box("a"), box("z")]), ("a.jpg", "g/1", [box("a")]), ("b.jpg", "g/1", [box("z")]), ("d.jpg", "g_1", [box("b")]), ("e.jpg", "h", [box("z")]), ("f.jpg", "h", [])]
    records = spark.createDataFrame(rows, "record string, group string, boxes array<struct<kind:string,x:double,y:double,w:double,h:double>>")
    found = rebuild.rebuilt(records, mapping={"a": 3, "b": 4}, prefix="set", most=2, best=[F.desc(F.size("boxes"))])
    got = {r.record: (r.name, r.version, [b.class_id for b in r.boxes]) for r in found.collect()}
    assert got["a.jpg"] == ("set__g_1__v1", 1, [3]) and got["c.jpg"] == ("set__g_1__v2", 2, [3])
    assert got["d.jpg"][0].startswith("set__g_1__v1__") and len(got["d.jpg"][0]) == len("set__g_1__v1__") + 10 and set(got) == {"a.jpg", "c.jpg", "d.jpg"}
    assert {r.content for r in rebuild.as_files(found, "train").filter("name = 'set__g_1__v1'").collect()} == {"3 0.100000 0.200000 0.300000 0.400000\n"}
    counts = {r.kind: (r.class_id, r.source_objects, r.images, r.objects) for r in rebuild.counted(records, found, {"a": 3, "b": 4}).collect()}
    assert counts == {"a": (3, 2, 2, 2), "b": (4, 1, 1, 1), "z": (None, 3, 0, 0)}
    assert [r[0] for r in spark.createDataFrame([("..a b/c..",), ("///",), ("x" * 300,)], "s string").select(rebuild.safe_stem(F.col("s"))).collect()] == ["a_b_c", "image", "x" * 150]


def test_a_public_projection(spark):
    df = spark.createDataFrame([(1, "k", (("t", 2),), [(("t", 3),)])], "id int, file_key string, job struct<inner:struct<token:string,n:int>>, runs array<struct<inner:struct<token:string,n:int>>>")
    got = projections.public(df, ["file_key", "job.inner.token", "runs.inner.token"], {"has_key": F.col("file_key").isNotNull()})
    assert got.schema.simpleString() == "struct<id:int,job:struct<inner:struct<n:int>>,runs:array<struct<inner:struct<n:int>>>,has_key:boolean>"
    assert got.first().runs[0].inner.n == 3 and got.first().has_key
    for wrong in ("tokn", "job.tokn", "runs.inner.tokn"):
        with pytest.raises(ValueError, match="no column"):
            projections.public(df, [wrong])


def test_scans_say_where_they_were_cut(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "alert string, at int")
    got = paging.bounded_scan(df, group="alert", order=["at"], most=5).collect()
    assert {(r.alert, r["at"], r.truncated) for r in got} == {("a", i, True) for i in range(5)} | {("b", 1, False)}


def test_first_match_makes_no_pairs(spark):
    left = spark.createDataFrame([(1, "f", 5, "z"), (2, "f", 6, "z"), (3, "f", 7, "y"), (4, "g", 1, "z"), (5, None, 1, "z")], "id int, frame string, region int, zone string")
    right = spark.createDataFrame([(30, "f", 5, "q"), (20, "f", None, "z"), (10, "f", 9, "q"), (25, "f", 5, "z")], "res int, frame string, r int, s string")
    got = joins.first_match(left, right, key="frame", rules=[({"region": "r"}, None), ({"zone": "s"}, F.col("r").isNull())], value="res", order="res").collect()
    assert {(r.id, r.res, r.rule) for r in got} == {(1, 25, 0), (2, 20, 1), (3, 10, 2), (4, None, None), (5, None, None)}


def test_periods(spark):
    rows = [("2026-01-01T10:00:00Z", "2026-01-01T14:00:00+03:00"), ("2026-01-01T10:00:00Z", "2026-01-01T13:00:00+03:00"), ("2026-01-01T10:00:00", None), (None, None), ("2026-01-01T10:00:00Z", None), ("x", None), (None, "2026-01-01 10:00:00-0500")]
    got = spark.createDataFrame(rows, "a string, b string").select(text.period_fault(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [None, "order", "zone", None, None, "time", None]
