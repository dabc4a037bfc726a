"""Alert episodes and runs on a stream, with typed state, timers and state that ends.

Each key has one value in the state store. After every batch a timer stands ``quiet`` behind
its last sample: when event time has passed it without input, what was live is interrupted
and published once more. A second timer, ``keep`` behind the last sample, drops the state.
The watermark drives the timers alone; samples out of order are treated as the rules say
(a step back begins anew), as long as the watermark's delay lets them in.

Episodes are told apart by their first sample, since a number would begin again with the
state; of the versions published of one, the greatest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from groma.streaming.episodes import Alert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ALERT = "episode long, first_seen double, last_seen double, status string, duration double, critical_duration double, above boolean, version long"
EPISODES = "fingerprint string, first_seen double, last_seen double, status string, duration double, critical_duration double, severity string, suppressed boolean, version long"
RUN = "attempt long, first double, last double, samples long, closed boolean, version long"
RUNS = "source string, attempt long, first double, last double, samples long, closed boolean, version long"


def sorted_samples(rows: Iterator[pd.DataFrame], *more: str) -> list[tuple]:
    """A key's samples of one batch by clock (clock and further columns); a batch is bounded by the source's rows per trigger."""
    samples = [x for r in rows for x in zip(r["clock"].tolist(), *(r[c].tolist() for c in more), strict=True)]
    return [samples[i] for i in np.argsort(np.array([x[0] for x in samples], np.float64), kind="stable").tolist()]


def batch_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(dict(zip((x.split()[0] for x in schema.split(", ")), zip(*rows, strict=True), strict=True)))


class Timed(StatefulProcessor):
    """Keeps one timer behind the last sample (quiet), then one for the end of the state (keep), in seconds of the clock."""

    def __init__(self, quiet: float, keep: float):
        self.quiet, self.keep = quiet, keep

    def after(self, seconds: float, *, first: bool = False) -> None:
        """first: the key had no state, so there is no timer to ask the store for."""
        for at in () if first else self.handle.listTimers():
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(int(np.ceil(seconds * 1000)))

    def close(self) -> None:
        pass


class EpisodeProcessor(Timed):
    """One fingerprint's alert: the fold of ``streaming.episodes``, closed by a timer where no sample comes."""

    def __init__(self, *, allowed: float, visible_after: float, critical_after: float, quiet: float, keep: float, unit: float):
        super().__init__(quiet, keep)
        self.allowed, self.visible_after, self.critical_after, self.unit = allowed, visible_after, critical_after, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("alert", ALERT)

    def row(self, key: tuple, a: Alert) -> tuple:
        severity = "critical" if a.above and a.critical_duration >= self.critical_after else "warning"
        return key[0], a.first_seen, a.last_seen, a.status, a.duration, a.critical_duration, severity, a.duration < self.visible_after, a.version

    def published(self, key: tuple, alerts: list[Alert]) -> Iterator[pd.DataFrame]:
        if alerts:
            yield batch_of([self.row(key, a) for a in alerts], EPISODES)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        alert = Alert(*self.state.get()) if known else Alert()
        found, last = {}, 0.0
        for clock, kind, above in sorted_samples(rows, "kind", "above"):
            last = max(last, clock)
            for a in alert.step(float(clock), kind, bool(above), self.allowed, self.visible_after):
                found[a.first_seen] = a
        self.state.update(astuple(alert))
        self.after(last / self.unit + self.quiet, first=not known)
        yield from self.published(key, list(found.values()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        alert = Alert(*self.state.get())
        if alert.status in ("open", "unknown"):
            alert.status, alert.version = "interrupted", alert.version + 1
            self.state.update(astuple(alert))
            self.after(alert.last_seen / self.unit + max(self.keep, self.quiet))
            yield from self.published(key, [alert])
        else:
            self.state.clear()


class RunProcessor(Timed):
    """One source's runs: a gap longer than ``quiet`` ends a run, and the next sample begins another attempt."""

    def __init__(self, *, quiet: float, keep: float, unit: float):
        super().__init__(quiet, keep)
        self.unit = unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", RUN)

    def published(self, key: tuple, runs: list[tuple]) -> Iterator[pd.DataFrame]:
        yield batch_of([(key[0], *r) for r in runs], RUNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        attempt, first, last, samples, closed, version = self.state.get() if known else (0, 0.0, 0.0, 0, True, 0)
        out = []
        for (clock,) in sorted_samples(rows):
            if samples and not closed and clock - last > self.quiet * self.unit:
                out.append((attempt, first, last, samples, True, version + 1))
                closed, version = True, version + 1
            if closed:
                attempt, first, samples, closed = attempt + 1, clock, 0, False
            last, samples = max(last, clock) if samples else clock, samples + 1
        version += 1
        now = (attempt, first, last, samples, closed, version)
        self.state.update(now)
        self.after(last / self.unit + self.quiet, first=not known)
        yield from self.published(key, [*out, now])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, first, last, samples, closed, version = self.state.get()
        if closed:
            self.state.clear()
            return
        now = (attempt, first, last, samples, True, version + 1)
        self.state.update(now)
        self.after(last / self.unit + max(self.keep, self.quiet))
        yield from self.published(key, [now])


def with_timed_state(spark: SparkSession) -> None:
    """Timers and typed state need a store that Spark does not choose by itself; a store that was chosen is left."""
    if spark.conf.get(PROVIDER, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


def timed(events: DataFrame, key: str, unit: float, delay: str) -> DataFrame:
    """events with a time that the watermark follows; the clock counts ``unit`` to the second."""
    return events.withColumn("clock", F.col("clock").cast("double")).withColumn("at", F.timestamp_micros((F.col("clock") / unit * 1_000_000).cast("long"))).withWatermark("at", delay)


def monitored(events: DataFrame, *, allowed: float, visible_after: float, critical_after: float, quiet: float = 60.0, keep: float = 3600.0, unit: float = 1.0, delay: str = "10 seconds") -> DataFrame:
    """events (a stream: fingerprint, clock, kind, above) -> versions of episodes; the bounds are in the clock's unit, quiet and keep in seconds."""
    with_timed_state(events.sparkSession)
    processor = EpisodeProcessor(allowed=allowed, visible_after=visible_after, critical_after=critical_after, quiet=quiet, keep=keep, unit=unit)
    rows = timed(events, "fingerprint", unit, delay).select("fingerprint", "clock", "kind", "above", "at")
    return rows.groupBy("fingerprint").transformWithStateInPandas(processor, EPISODES, "Append", "EventTime")


def runs(events: DataFrame, *, quiet: float = 60.0, keep: float = 86_400.0, unit: float = 1.0, delay: str = "10 seconds") -> DataFrame:
    """events (a stream: source, clock) -> versions of each source's runs."""
    with_timed_state(events.sparkSession)
    rows = timed(events, "source", unit, delay).select("source", "clock", "at")
    return rows.groupBy("source").transformWithStateInPandas(RunProcessor(quiet=quiet, keep=keep, unit=unit), RUNS, "Append", "EventTime")


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest version of each."""
    rest = [c for c in versions.columns if c not in (*keys, "version")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*keys, "_r.*")


def run_available(versions: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs over what there is, and returns all versions that have been written."""
    start(versions, path, checkpoint).awaitTermination()
    return versions.sparkSession.read.schema(versions.schema).parquet(path)


def start(versions: DataFrame, path: str, checkpoint: str, interval: float | None = None) -> StreamingQuery:
    """A query that ticks every ``interval`` seconds; without one, it ends when it has taken what there is."""
    trigger = {"availableNow": True} if interval is None else {"processingTime": f"{max(1, round(interval * 1000))} milliseconds"}
    return versions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_projects(events: DataFrame, versions: Callable[[DataFrame], DataFrame], intervals: Mapping[str, float], root: str, *, project: str = "project_id") -> dict[str, StreamingQuery]:
    """A query for each project, ticking at the project's own interval (a bounded list: the projects that are monitored)."""
    return {name: start(versions(events.filter(F.col(project) == name).drop(project)), f"{root}/{name}/out", f"{root}/{name}/state", interval) for name, interval in intervals.items()}
