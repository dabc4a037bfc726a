"""Joins, plans, geometry, curation and files."""

import random

from groma.functions import geometry, text
from groma.operators import curation, joins, paging
from groma.plans import cascade
from groma.sources import files
from pyspark.sql import functions as F


def test_interval_join_against_brute_force(spark):
    rng = random.Random(1)
    points = [(i, rng.randint(0, 2), rng.randint(-50, 300)) for i in range(200)]
    spans = [(i, rng.randint(0, 2), a := rng.randint(-60, 280), a + rng.randint(0, 70)) for i in range(60)]
    got = joins.interval_join(spark.createDataFrame(points, "p int, k int, t int"), spark.createDataFrame(spans, "s int, k int, a int, b int"), key="k", at="t", starts="a", ends="b", width=30)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, k, t in points for s, j, a, b in spans if k == j and a <= t < b)


def test_hamming_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(63)) for i in range(40)]
    rows += [(100 + i, rows[i][1] ^ sum(1 << b for b in rng.sample(range(63), i % 6))) for i in range(40)]
    got = {(r.a, r.b): r.distance for r in joins.hamming_pairs(spark.createDataFrame(rows, "id long, bits long"), key="id", bits="bits", most=4).collect()}
    assert got == {(a, b): d for a, x in rows for b, y in rows if a < b and (d := (x ^ y).bit_count()) <= 4}


def test_hamming_pairs_of_one_frequent_band(spark, monkeypatch):
    """Rows that agree in a band are spread over blocks: no group of rows holds them all, and each pair comes once."""
    monkeypatch.setattr(joins, "HAMMING_BLOCK", 50)
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(6) << 18) for i in range(300)] + [(300 + i, rng.getrandbits(24)) for i in range(100)]
    found = joins.hamming_pairs(spark.createDataFrame(rows, "id long, bits long"), key="id", bits="bits", most=4, width=24)
    got = [(r.a, r.b, r.distance) for r in found.collect()]
    assert sorted(got) == sorted((a, b, d) for a, x in rows for b, y in rows if a < b and (d := (x ^ y).bit_count()) <= 4)


def test_hamming_pairs_of_all_64_signs(spark):
    rng = random.Random(6)
    base = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(6)]
    rows = []
    for i in range(120):
        v = list(base[i % 6])
        for at in rng.sample([0, 1, 30, 62, 63], rng.randint(0, 4)):
            v[at] = -v[at]
        rows.append((i, v))
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", joins.sign_bits(F.col("v")).alias("bits"))
    got = [(r.a, r.b, r.distance) for r in joins.hamming_pairs(df, key="id", bits="bits", most=4).collect()]
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    assert sorted(got) == sorted((a, b, apart(x, y)) for a, x in rows for b, y in rows if a < b and apart(x, y) <= 4)


def test_polygons(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)]
    zone = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in square])
    df = spark.createDataFrame([(0.5, 0.2, True), (1.0, 0.2, True), (0.5, 0.5, True), (1.01, 0.2, False), (0.5, 0.51, False)], "x double, y double, want boolean")
    got = df.select("want", geometry.inside(F.struct("x", "y"), zone).alias("got"), geometry.polygon_area(zone).alias("a")).collect()
    assert all(r.want == r.got and abs(r.a - 0.5) < 1e-12 for r in got)


def test_cascade_pushes_later_siblings_only(spark):
    works = spark.createDataFrame([("p", 1, 0, 4, False), ("p", 2, 4, 6, True), ("p", 3, 5, 9, False), ("p", 4, 30, 31, False), ("q", 1, 0, 1, False)], "plan string, w int, s int, e int, t boolean")
    got = {(r.plan, r.w): (r.s, r.e, r.changed) for r in cascade.shift(works, plan="plan", order=["w"], starts="s", ends="e", target=F.col("t"), by=2).collect()}
    assert got == {("p", 1): (0, 4, False), ("p", 2): (4, 8, True), ("p", 3): (8, 12, True), ("p", 4): (30, 31, False), ("q", 1): (0, 1, False)}


def test_codes_sort_by_their_numbers(spark):
    df = spark.createDataFrame([("12.10",), ("2.1",), ("12.2",), ("12",)], "code string")
    assert [r.code for r in df.orderBy(text.code_key(F.col("code"))).collect()] == ["2.1", "12", "12.2", "12.10"]


def test_search_and_cells(spark):
    df = spark.createDataFrame([("Щебёночный слой", "=1+1"), (None, "a")], "s string, c string")
    got = df.select(text.matches_search(F.col("s"), "слой щебен").alias("m"), text.safe_cell(F.col("c")).alias("c")).collect()
    assert [(r.m, r.c) for r in got] == [(True, "'=1+1"), (False, "a")]


def test_pages_add_up_to_the_whole(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(40)], "t int, id int")
    rows, after = [], None
    while page := paging.keyset_page(df, ["t", "id"], 9, after).collect():
        rows += [(r.t, r.id) for r in page]
        after = rows[-1]
    assert rows == sorted(((i % 7, i) for i in range(40)), reverse=True)


def test_components_over_shared_keys(spark):
    pairs = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "c"), *[(100 + i, f"k{i}") for i in range(30)], *[(101 + i, f"k{i}") for i in range(30)]]
    got = {r.id: r.component for r in curation.components(spark, spark.createDataFrame(pairs, "id long, key string"), record="id", key="key").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, **{100 + i: 100 for i in range(31)}}


def test_suppression_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f, i, rng.random(), (x := rng.random() * 0.5, y := rng.random() * 0.5, x + 0.3, y + 0.3)) for f in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "frame int, row int, score double, box struct<x1:double,y1:double,x2:double,y2:double>").withColumn("kind", F.lit("k"))
    got = {(r.frame, r.row) for r in curation.suppress(df, frame="frame", box="box", score="score", kind="kind", row="row").collect()}

    def iou(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / (0.18 - both)

    want = set()
    for f in range(4):
        kept = []
        for _, i, _, box in sorted((r for r in rows if r[0] == f), key=lambda r: -r[2]):
            if all(iou(box, k) <= 0.5 for k in kept):
                kept.append(box)
                want.add((f, i))
    assert got == want


def test_plan_files_return_faults_as_rows(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("﻿Code;Title;Start;End;Crane\n12.1;T;16.09.2026 09:00;16.09.2026 12:00;2\n12.x;U;16.09.2026 09:00;oops;\n", encoding="utf-8")
    headers = {"code": ["Code"], "title": ["Title"], "starts_at": ["Start"], "ends_at": ["End"]}
    a, b = files.plan_rows(spark, str(tmp_path / "plan.csv"), headers=headers, classes={"Crane": "16"}, zone="Europe/Moscow").orderBy("code").collect()
    assert a.errors == [] and a.resources == {"16": 2} and a.starts_at.hour in (6, 9) and b.errors == ["code", "time"] and b.resources == {"16": 0}


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.3 0.1 0.3 0.5 0.1 0.5\nx 1 2\n\n")
    got = {r.line[0]: r for r in files.box_labels(spark, str(tmp_path / "a.txt")).collect()}
    assert got["0"].valid and got["1"].valid and not got["x"].valid
    assert abs(got["1"].x - 0.2) < 1e-9 and abs(got["1"].h - 0.4) < 1e-9


def test_digest_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    assert files.digest(df).first() == files.digest(df.repartition(3).select("s", "i")).first()
    assert files.digest(df).first() != files.digest(df.dropDuplicates()).first()
