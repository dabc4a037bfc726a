"""Time series of counts: segments, durations, buckets, debounced levels, states.

Null is "not measurable", zero is "measured, none"; the two are never exchanged. Clocks are
numbers (seconds or microseconds), and all bounds are in the same unit.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groma.operators.ordered import PART, Ordered, folded

#: A frame counts as due so many units early.
SLACK = 0.001


def segments(obs: DataFrame, *, run: str = "run_id", clock: str = "clock", usable: str = "usable", row: str = "id", max_gap: float, supported: str | None = None) -> DataFrame:
    """obs with segment, numbered from 0 in each run: a new one begins after a gap, where the clock stands or falls back, at either side of an unusable sample, and where the supported classes change."""
    before = {"_clock": F.col(clock), "_usable": F.col(usable)} | ({"_supported": F.array_sort(F.col(supported))} if supported else {})
    beside = Ordered.of(obs, [run], [clock, row]).neighbours(before=before)
    step = F.col(clock) - F.col("_clock")
    cut = (step > max_gap) | (step <= 0) | ~F.col(usable) | ~F.col("_usable")
    if supported:
        cut = cut | ~F.array_sort(F.col(supported)).eqNullSafe(F.col("_supported"))
    cut = F.when(step.isNull(), False).otherwise(F.coalesce(cut, F.lit(False)))
    marked = beside.having(beside.rows.withColumn("_cut", cut.cast("int")).drop(*before))
    return marked.running(F.col("_cut"), "segment").done().drop("_cut")


def durations(df: DataFrame, *, step: float, run: str = "run_id", clock: str = "clock", row: str = "id", finest: float | None = None) -> DataFrame:
    """df with span: the time to the next sample of the segment, ``step`` at most, 0 for the last one. Samples further apart than ``finest`` stand for no time at all."""
    if finest is not None and step > finest:
        return df.withColumn("span", F.lit(0))
    beside = Ordered.of(df, [run], [clock, row]).neighbours(after={"_clock": F.col(clock), "_segment": F.col("segment")}).done()
    span = F.when(F.col("_segment") == F.col("segment"), F.least(F.col("_clock") - F.col(clock), F.lit(step)))
    return beside.withColumn("span", F.coalesce(span, F.lit(0))).drop("_clock", "_segment")


def buckets(df: DataFrame, *, size: float, run: str = "run_id", clock: str = "clock", row: str = "id", value: str = "count", span: str = "span") -> DataFrame:
    """run, segment, bucket, sample_count, total span and the last sample's value. The last sample stands for the bucket, not the largest."""
    last = F.max_by(value, F.struct(clock, row))
    return df.groupBy(run, "segment", F.floor(F.col(clock) / size).alias("bucket")).agg(F.count(F.lit(1)).alias("sample_count"), F.sum(span).alias("seconds"), last.alias("last_value"))


def confirmed_levels(df: DataFrame, *, size: float, least: float, run: str = "run_id", clock: str = "clock", row: str = "id", value: str = "count", span: str = "span") -> DataFrame:
    """The last value of each bucket, if values at least as high fill ``least`` of it, else null.

    One shuffle: the bucket's samples are summed by value first, so a bucket's row count does not matter.
    """
    keys = [run, "segment", "bucket"]
    by_value = df.withColumn("bucket", F.floor(F.col(clock) / size)).groupBy(*keys, F.col(value).alias("level")).agg(F.sum(span).alias("held"), F.max(F.struct(clock, row)).alias("last"))
    found = by_value.groupBy(*keys).agg(F.max_by("level", "last").alias("level"), F.collect_list(F.struct("level", "held")).alias("all"))
    held = F.aggregate(F.filter("all", lambda x: x["level"] >= F.col("level")), F.lit(0).cast(df.schema[span].dataType), lambda s, x: s + x["held"])
    return found.select(*keys, F.when(held >= least, F.col("level")).alias("confirmed"))


def display_levels(df: DataFrame, *, size: float, step: float, cap: float, least: float, run: str = "run_id", clock: str = "clock", row: str = "id", value: str = "count") -> DataFrame:
    """run, segment, bucket, level, basis, presence: what is shown for a bucket of a coarse chart.

    The level is the last sample's. It is confirmed if values at least as high fill ``least``
    of the bucket; a sample stands for the time to the next one in its bucket, the last one for
    ``step``, and none for more than ``cap``. A level that is not confirmed was merely sampled,
    and says nothing of presence; null was not measured.
    """
    bucketed = df.withColumn("bucket", F.floor(F.col(clock) / size).cast("long"))
    beside = Ordered.of(bucketed, [run], [clock, row]).neighbours(after={"_clock": F.col(clock), "_segment": F.col("segment"), "_bucket": F.col("bucket")}).done()
    follows = (F.col("_segment") == F.col("segment")) & (F.col("_bucket") == F.col("bucket"))
    span = F.least(F.when(F.coalesce(follows, F.lit(False)), F.col("_clock") - F.col(clock)).otherwise(F.lit(step)), F.lit(step), F.lit(cap))
    keys = [run, "segment", "bucket"]
    spans = beside.withColumn("_span", F.greatest(span, F.lit(0)))
    # a bucket's samples are summed by value first, so that their number does not matter
    by_value = spans.groupBy(*keys, F.col(value).alias("level")).agg(F.sum("_span").alias("held"), F.max(F.struct(clock, row)).alias("last"))
    found = by_value.groupBy(*keys).agg(F.max_by("level", "last").alias("level"), F.collect_list(F.struct("level", "held")).alias("all"))
    held = F.aggregate(F.filter("all", lambda x: x["level"] >= F.col("level")), F.lit(0).cast(spans.schema["_span"].dataType), lambda s, x: s + x["held"])
    basis = F.when(F.col("level").isNull(), "unknown").when(held >= least, "confirmed").otherwise("sampled")
    presence = F.when(F.col("basis") != "confirmed", "unknown").when(F.col("level") > 0, "present").otherwise("absent")
    return found.withColumn("basis", basis).select(*keys, "level", "basis", presence.alias("presence"))


def activity_split(idle: Column, working: Column, count: Column, raw: Column) -> Column:
    """working, idle and unknown things; all null where nothing was counted."""
    most = F.greatest(count, raw)
    rest = F.greatest(F.lit(0), most - idle - working)
    return F.when(most.isNotNull(), F.struct(working.alias("working"), idle.alias("idle"), rest.alias("unknown")))


def partial_sum(value: Column) -> Column:
    """Aggregate: the sum if every value is known or any is above zero, else null."""
    return F.when((F.count(F.lit(1)) == F.count(value)) | (F.max(value) > 0), F.sum(value))


class Debounce:
    """Level of one class within a segment: a new level must hold for ``change``, an absence for ``absence``."""

    def __init__(self, absence: float, change: float):
        self.absence, self.change = absence, change
        self.clear()

    def clear(self) -> None:
        self.stable = self.zero_since = self.level = self.level_since = self.upward = None

    def state(self) -> str:
        return json.dumps([self.stable, self.zero_since, self.level, self.level_since, self.upward])

    def restore(self, state: str) -> None:
        self.stable, self.zero_since, self.level, self.level_since, self.upward = json.loads(state)

    def step(self, clock: float, raw: int | None) -> tuple[int | None, str]:
        if raw is None:
            self.clear()
            return None, "unknown"
        settled = raw == self.stable or self.stable is None and (raw > 0 or self.absence <= 0)
        if settled:
            self.clear()
            self.stable = raw
        elif raw == 0:
            self.level = self.level_since = self.upward = None
            self.zero_since = clock if self.zero_since is None else self.zero_since
            if clock - self.zero_since < self.absence:
                return self.stable, "pending"
            self.clear()
            self.stable = 0
        else:
            self.zero_since = None
            upward = raw > self.stable
            if upward != self.upward:
                self.level, self.level_since, self.upward = raw, clock, upward
            else:
                self.level = min(self.level, raw) if upward else max(self.level, raw)
            if clock - self.level_since < self.change:
                return self.stable, "pending"
            level = self.level
            self.clear()
            self.stable = level
        return self.stable, "present" if self.stable else "absent"


def debounce(df: DataFrame, *, absence: float, change: float, run: str = "run_id", clock: str = "clock", row: str = "id", value: str = "raw_count", kind: str = "class_id") -> DataFrame:
    """run, segment, class, id, clock, raw_count, count, presence.

    The level depends on all that came before it in its segment, which no window expresses: a
    fold. An unknown count clears the state, and any level that holds for long enough settles
    it, so ranges of a long segment soon agree with what came before them.
    """
    rows = df.select(run, F.col("segment").cast("long"), kind, row, F.col(clock).cast("double").alias(clock), F.col(value).cast("long").alias(value))
    return folded(rows, keys=[run, "segment", kind], order=[clock, row], reads=[clock, value], machine=lambda: Debounce(absence, change), gives="count long, presence string")


def absence_states(df: DataFrame, *, need: Column, confirm: float, allowed: float, run: str = "run_id", clock: str = "clock", row: str = "id", value: str = "count") -> DataFrame:
    """df with state (present, absent, pending, unknown) and owned, the time to the run's next sample.

    An island of too small counts begins after a gap, an unknown or a sufficient count; absence
    is confirmed from ``confirm`` after the island's start. Time across a gap is unknown.
    """
    low = F.coalesce(F.col(value) < need, F.lit(False))
    rows = Ordered.of(df.withColumn("_low", low), [run], [clock, row])
    rows = rows.neighbours(before={"_before": F.col(clock), "_was_low": F.col("_low")}, after={"_after": F.col(clock)})
    start = F.col("_low") & (F.coalesce(~F.col("_was_low"), F.lit(True)) | F.coalesce(F.col(clock) - F.col("_before") > allowed, F.lit(False)))
    since = rows.carried(F.when(start, F.col(clock)), "_since").done()
    state = F.when(F.col(value).isNull(), "unknown").when(~F.col("_low"), "present").when(F.col(clock) - F.col("_since") >= confirm, "absent").otherwise("pending")
    owned = F.coalesce(F.col("_after") - F.col(clock), F.lit(0))
    stated = since.withColumn("owned", owned).withColumn("state", F.when(F.col("owned") > allowed, "unknown").otherwise(state))
    return stated.drop("_low", "_before", "_was_low", "_after", "_since")


def bucket_states(df: DataFrame, *, size: float, states: dict[str, Column], run: str = "run_id", clock: str = "clock", row: str = "id", span: str = "span") -> DataFrame:
    """run, segment, bucket, sample_count, the seconds of each state, and the row that stands for the bucket, its last one."""
    seconds = [F.coalesce(F.sum(n * F.col(span)), F.lit(0)).alias(name) for name, n in states.items()]
    return df.groupBy(run, "segment", F.floor(F.col(clock) / size).alias("bucket")).agg(F.count(F.lit(1)).alias("sample_count"), *seconds, F.max_by(row, F.struct(clock, row)).alias("last_row"))


def absence_ratios(stated: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Per run the time in each state, and absent / (present + absent), null where neither was seen."""
    own = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("owned"))), F.lit(0)).alias(s)
    found = stated.groupBy(run).agg(*[own(s) for s in ("present", "absent", "pending", "unknown")])
    return found.withColumn("absence_ratio", F.try_divide(F.col("absent"), F.col("present") + F.col("absent")).cast("double"))


def keyframes(df: DataFrame, *, run: str = "run_id", clock: str = "clock", row: str = "id", most: int = 6) -> DataFrame:
    """At most ``most`` rows of each run, evenly spaced from the first to the last."""
    placed = Ordered.of(df, [run], [clock, row]).numbered("_at", "_n").done()
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (most - 1)).cast("long") + 1)
    return placed.filter((F.col("_n") <= most) | F.array_contains(chosen, F.col("_at").cast("long"))).drop("_at", "_n")


def state_seconds(df: DataFrame, *, states: dict[str, Column], run: str = "run_id", span: str = "span") -> DataFrame:
    """Per run the time that things spent in each state: the number in the state times the sample's span, nulls left out."""
    return df.groupBy(run).agg(*[F.coalesce(F.sum(n * F.col(span)), F.lit(0)).alias(name) for name, n in states.items()])


def run_lengths(df: DataFrame, *, run: str, clock: str, row: str, value: str) -> DataFrame:
    """run, value, first, last, n: stretches of equal neighbouring values; nulls are equal to each other."""
    beside = Ordered.of(df, [run], [clock, row]).neighbours(before={"_value": F.col(value), "_row": F.col(row)})
    cut = F.col("_row").isNull() | ~F.col(value).eqNullSafe(F.col("_value"))
    marked = beside.running(cut.cast("int"), "_run").done()
    return marked.groupBy(run, "_run").agg(F.first(value).alias(value), F.min(clock).alias("first"), F.max(clock).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def linked(df: DataFrame, *, run: str, clock: str, row: str, step: float, least: float = 90) -> DataFrame:
    """df with linked: whether the next point is near enough to be joined by a line; false for the last one."""
    beside = Ordered.of(df, [run], [clock, row]).neighbours(after={"_clock": F.col(clock)}).done()
    return beside.withColumn("linked", F.coalesce(F.col("_clock") - F.col(clock) <= max(1.5 * step, least), F.lit(False))).drop("_clock")


def viewing_window(df: DataFrame, *, run: str, clock: str, length: float) -> DataFrame:
    """The rows of each run within ``length`` of its last one. The ends come from one aggregate, so runs are not sorted."""
    ends = df.groupBy(run).agg(F.max(clock).alias("_end"))
    return df.join(ends, run).filter(F.col(clock) >= F.col("_end") - length).drop("_end")


class Sampler:
    """Keeps a frame once its time has come, and counts the next one from there, so that samples drift with the frames."""

    def __init__(self, step: float, slack: float = SLACK):
        self.wait, self.slack, self.due = step, slack, None

    def state(self) -> str:
        return json.dumps(self.due)

    def restore(self, state: str) -> None:
        self.due = json.loads(state)

    def step(self, at: float) -> tuple[bool]:
        if self.due is not None and at + self.slack < self.due:
            return (False,)
        self.due = at + self.wait
        return (True,)


def sampler_tables(clocks: np.ndarray, step: float) -> tuple[list[float], list[float]]:
    """What a stretch of frames does to a sampler, as a function of the time that is due when it begins.

    For each frame that can be the first one kept (those up to a step behind the start): the
    latest time due with which it is, and the time due after the last frame.
    """
    later = np.searchsorted(clocks + SLACK, clocks + step).tolist()
    due = [0.0] * len(clocks)
    for i in range(len(clocks) - 1, -1, -1):
        due[i] = due[later[i]] if later[i] < len(clocks) else float(clocks[i]) + step
    n = min(later[0] + 1, len(clocks))
    return (clocks[:n] + SLACK).tolist(), due[:n]


def sampler_entries(placed: Ordered, *, step: float, run: str, clock: str) -> DataFrame:
    """run, PART, _entry: the ranges' functions, worked out in parallel, are applied one after the other to the time due. A range is one small row there."""
    kind = placed.rows.schema[run].dataType.simpleString()

    def tables(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        upto, due = sampler_tables(np.sort(frames[clock].to_numpy(np.float64)), step)
        return pd.DataFrame({run: [key[0]], PART: [key[1]], "upto": [upto], "due": [due]})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, None
        for batch in batches:
            entries = []
            keys = batch[run].astype(object).where(batch[run].notna(), None).tolist()
            for key, upto, due in zip(keys, batch["upto"], batch["due"], strict=True):
                if last is None or key != last[0]:
                    last, now = (key,), None
                entries.append(None if now is None else json.dumps(now))
                at = 0 if now is None else bisect_left(upto, now)
                now = float(due[at]) if at < len(due) else now
            yield batch[[run, PART]].assign(_entry=entries)

    # a range is at most ROWS_IN_A_TASK or its share of all rows; only its clocks are held
    found = placed.rows.select(run, PART, clock).groupBy(run, PART).applyInPandas(tables, f"`{run}` {kind}, {PART} int, upto array<double>, due array<double>")
    return found.repartition(run).sortWithinPartitions(run, PART).mapInPandas(chain, f"`{run}` {kind}, {PART} int, _entry string")


def sampled(df: DataFrame, *, step: float, run: str = "run_id", clock: str = "clock", row: str = "id") -> DataFrame:
    """The drifting sample of each run: run, clock, row. Each choice depends on the one before: a fold, whose ranges are functions of one number."""
    rows = df.select(run, F.col(clock).cast("double").alias(clock), row)
    entries = lambda placed: sampler_entries(placed, step=step, run=run, clock=clock)
    return folded(rows, keys=[run], order=[clock, row], reads=[clock], machine=lambda: Sampler(step), gives="keeps boolean", entries=entries).filter("keeps").drop("keeps")
