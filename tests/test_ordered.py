"""Windows and folds of runs that are spread over ranges, against plain windows and one fold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from groma import catalogue, queries  # noqa: F401
from groma.operators import ordered, series
from groma.operators.ordered import Ordered

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def spread(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_IN_A_TASK", 20)


def skewed(spark, n=1500):
    """Two thirds of the rows are of one run; runs and values can be null."""
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.7 else f"r{rng.randrange(9)}", float(rng.randrange(400)), i, rng.choice([None, None, None, 0, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, clock double, id long, raw_count long").withColumn("part", F.lit("own"))


def test_ordered_windows_equal_plain_ones(spark, spread):
    df = skewed(spark)
    w = Window.partitionBy("run_id").orderBy("clock", "id")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "id",
        F.lag("raw_count").over(w).alias("b"),
        F.lead("id").over(w).alias("a"),
        F.coalesce(F.sum("raw_count").over(up), F.lit(0)).alias("s"),
        F.row_number().over(w).alias("at"),
        F.count(F.lit(1)).over(Window.partitionBy("run_id")).alias("n"),
        F.last("raw_count", ignorenulls=True).over(up).alias("f"),
        F.first("raw_count", ignorenulls=True).over(down).alias("g"),
    )
    rows = Ordered.of(df, ["run_id"], ["clock", "id"])
    assert rows.spread and rows.rows.filter("run_id = 'hot'").select(ordered.PART).distinct().count() > 2
    rows = rows.neighbours(before={"b": F.col("raw_count")}, after={"a": F.col("id")}).running(F.col("raw_count"), "s")
    got = rows.numbered("at", "n").carried(F.col("raw_count"), "f").carried(F.col("raw_count"), "g", back=True).done().select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.part for r in rows.done().select("part").collect()} == {"own"} and ordered.PART not in rows.done().columns


def test_a_short_run_is_not_laid_out(spark):
    rows = Ordered.of(skewed(spark), ["run_id"], ["clock", "id"])
    assert not rows.spread and ordered.PART not in rows.done().columns
    assert Ordered.of(skewed(spark).filter("false"), ["run_id"], ["clock", "id"]).running(F.lit(1), "n").done().count() == 0


@pytest.mark.parametrize("name", ["q07_segments", "q08_sample_durations", "q10_debounce", "q16_episodes", "q19_state_durations", "q20_keyframes", "q105_run_lengths", "q106_linked_points", "q114_nearest_in_time", "q119_run_attempts", "q121_drifting_sample"])
def test_queries_give_the_same_rows_when_runs_are_spread(spark, monkeypatch, name):
    rows = lambda: sorted(str(r) for r in catalogue.QUERIES[name](spark, SMALL).collect())
    plain = rows()
    monkeypatch.setattr(ordered, "ROWS_IN_A_TASK", 8)
    assert plain and rows() == plain


def levels(rng, n):
    """Counts that waver for long: a range does not begin as it would by itself."""
    level, out = 2, []
    for i in range(n):
        if rng.random() < 0.02:
            level = rng.randrange(4)
        raw = None if rng.random() < 0.002 else max(0, level + rng.choice([0, 0, 0, 1, -1]))
        out.append(("r", 0, "x", i, float(i), raw))
    return out


def test_debounce_in_ranges_equals_one_fold(spark, monkeypatch):
    df = spark.createDataFrame(levels(random.Random(9), 3000), "run_id string, segment long, class_id string, id long, clock double, raw_count long")
    rows = lambda: [tuple(r) for r in series.debounce(df, absence=25, change=12).orderBy("id").collect()]
    plain = rows()
    monkeypatch.setattr(ordered, "ROWS_IN_A_TASK", 100)
    assert rows() == plain and len({r[-2] for r in plain}) > 2


@pytest.mark.parametrize("step", [1.0, 7.3, 400.0])
def test_drifting_sample_in_ranges_equals_one_fold(spark, monkeypatch, step):
    """Frames at even intervals: two samplers that begin apart never agree, so ranges are functions of the time due."""
    df = spark.range(3000).select(F.lit("r").alias("run_id"), (F.col("id") * 0.4).alias("clock"), "id")
    rows = lambda: [tuple(r) for r in series.sampled(df, step=step).orderBy("id").collect()]
    plain = rows()
    monkeypatch.setattr(ordered, "ROWS_IN_A_TASK", 100)
    assert rows() == plain


def test_notices_in_ranges_equal_one_fold(spark, monkeypatch):
    from groma.streaming.notices import notices

    rng, rows, t = random.Random(2), [], 0.0
    for i in range(2500):
        t += rng.choice([0.1, 0.5, 1.0, 3.0, 9.0])
        rows.append((7, t, i, rng.choice(["ready", "failed", "cancelled", "started", "done"]), f"k{rng.randrange(40)}"))
    df = spark.createDataFrame(rows, "user_id long, clock double, event_id long, kind string, key string")
    got = lambda: [tuple(r) for r in notices(df).orderBy("event_id").collect()]
    plain = got()
    monkeypatch.setattr(ordered, "ROWS_IN_A_TASK", 100)
    assert got() == plain and max(r[-1].count(",") for r in plain) == 2


def test_a_null_run_is_one_run(spark, monkeypatch):
    df = spark.range(900).select(F.when(F.col("id") >= 300, 1.0 * (F.col("id") % 2)).alias("run_id"), (F.col("id") * 0.4).alias("clock"), "id")
    rows = lambda: sorted(str(tuple(r)) for r in series.sampled(df, step=7.3).collect())
    plain = rows()
    monkeypatch.setattr(ordered, "ROWS_IN_A_TASK", 50)
    assert rows() == plain


def test_a_sampler_table_is_the_sampler(spark):
    import numpy as np

    rng = random.Random(1)
    clocks = np.sort(np.array([rng.uniform(0, 50) for _ in range(200)]))
    upto, due = series.sampler_tables(clocks, 3.0)
    for start in np.linspace(clocks[0] - 1, clocks[0] + 3.0, 60):
        sampler = series.Sampler(3.0)
        sampler.due = float(start)
        for at in clocks.tolist():
            sampler.step(at)
        at = series.bisect_left(upto, float(start))
        assert (due[at] if at < len(due) else float(start)) == sampler.due
