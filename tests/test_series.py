"""Golden vectors and brute force for the ordered folds."""

import random

import pytest
from groma.operators import episodes, series
from groma.streaming.episodes import Alert


def levels(spark, counts, step=1, absence=30, change=10):
    rows = [("r", 0, "0", i, float(i * step), c) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "run_id string, segment long, class_id string, id long, clock double, raw_count long")
    got = series.debounce(df, absence=absence, change=change).orderBy("id").collect()
    return [r["count"] for r in got], [r["presence"] for r in got]


def test_debounce_holds_and_confirms(spark):
    counts, presence = levels(spark, [3, 0, 3, 0, 0], step=10, absence=10)
    assert counts == [3, 3, 3, 3, 0]
    assert presence == ["present", "pending", "present", "pending", "absent"]


@pytest.mark.parametrize(("after", "wait"), [(2, 10), (0, 30)])
def test_debounce_flips_at_the_bound(spark, after, wait):
    counts, _ = levels(spark, [4] * 40 + [after] * (wait + 5))
    assert counts.index(after) == 40 + wait


def test_debounce_takes_the_cautious_level_of_a_wavering_drop(spark):
    counts, _ = levels(spark, [4] * 12 + [3 if i % 3 else 2 for i in range(15)])
    assert counts[21] == 4 and counts[22] == 3


def test_debounce_unknown_clears_and_zero_waits(spark):
    counts, presence = levels(spark, [None, 0, 0, 2, None, 0])
    assert counts == [None, None, None, 2, None, None]
    assert presence == ["unknown", "pending", "pending", "present", "unknown", "pending"]


def test_debounce_of_an_empty_table(spark):
    df = spark.createDataFrame([], "run_id string, segment long, class_id string, id long, clock double, raw_count long")
    assert series.debounce(df, absence=1, change=1).count() == 0


def test_segments_after_gaps_and_unusable_frames(spark):
    rows = [(i, "r", float(t), u) for i, (t, u) in enumerate([(0, True), (1, True), (2, True), (20, True), (21, False), (22, True)])]
    df = spark.createDataFrame(rows, "id long, run_id string, clock double, usable boolean")
    assert [r.segment for r in series.segments(df, max_gap=3).orderBy("id").collect()] == [0, 0, 0, 1, 2, 3]
    assert [r.segment for r in series.segments(df.filter("id = 4"), max_gap=3).collect()] == [0]


def test_keyframes_of_short_and_long_runs(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", float(i)) for i in range(5 + 101)], "id long, run_id string, clock double")
    got = {(r.run_id, r.id) for r in series.keyframes(df).collect()}
    assert {i for k, i in got if k == "a"} == set(range(5))
    assert {i - 5 for k, i in got if k == "b"} == {0, 20, 40, 60, 80, 100}


def test_partial_sum_keeps_unknown_apart_from_zero(spark):
    df = spark.createDataFrame([(1, None), (1, 0), (2, None), (2, 3), (3, 0), (3, 0)], "k int, v int")
    assert {r.k: r.s for r in df.groupBy("k").agg(series.partial_sum(df.v).alias("s")).collect()} == {1: None, 2: 3, 3: 0}


def test_windows_and_fold_agree_on_random_streams(spark):
    rng, rows = random.Random(3), []
    for key in range(60):
        t = 0
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([1, 2, 3, 9])
            rows.append((str(key), t, rng.choice("FFFCN"), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "fingerprint string, clock long, kind string, above boolean")
    got = {(r.fingerprint, r.episode): (r.first_seen, r.last_seen, r.status, r.duration, r.critical_duration) for r in episodes.episodes(df, allowed=4, visible_after=3, critical_after=4).collect()}
    want, states = {}, {}
    for key, t, kind, above in rows:
        for a in states.setdefault(key, Alert()).step(t, kind, above, 4, 3):
            want[key, a.episode] = (a.first_seen, a.last_seen, a.status, a.duration, a.critical_duration)
    assert got == want


def test_durations_end_with_their_segment(spark):
    rows = [("r", 0, 0, 0.0), ("r", 0, 1, 0.5), ("r", 0, 2, 5.0), ("r", 1, 3, 5.5), ("s", 0, 4, 0.0)]
    df = spark.createDataFrame(rows, "run_id string, segment long, id long, clock double")
    assert [r.span for r in series.durations(df, step=1.0).orderBy("id").collect()] == [0.5, 1.0, 0.0, 0.0, 0.0]
    assert [r.span for r in series.durations(df, step=3.0, finest=2.0).collect()] == [0] * 5


def test_display_levels(spark):
    """The last sample of a bucket stands for a step; time is capped; a drop that lasted is kept, a spike is not."""
    counts = [3] * 20 + [5] * 3 + [2] * 7 + [4] * 25 + [0] * 5 + [None] * 60
    df = spark.createDataFrame([("r", 0, i, float(i), c) for i, c in enumerate(counts)], "run_id string, segment long, id long, clock double, count long")
    got = [tuple(r)[2:] for r in series.display_levels(df, size=30.0, step=1.0, cap=2.0, least=10.0).orderBy("bucket").collect()]
    assert got == [(0, 2, "confirmed", "present"), (1, 0, "confirmed", "absent"), (2, None, "unknown", "unknown"), (3, None, "unknown", "unknown")]
    sparse = spark.createDataFrame([("r", 0, i, i * 6.0, c) for i, c in enumerate([1, 1, 1, 1, 2])], "run_id string, segment long, id long, clock double, count long")
    assert [tuple(r)[3:] for r in series.display_levels(sparse, size=30.0, step=6.0, cap=2.0, least=10.0).collect()] == [(2, "sampled", "unknown")]
