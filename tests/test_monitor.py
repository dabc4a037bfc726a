"""Streams with timers: episodes and runs that close without input, and state that ends."""

import time

import pytest
from pyspark.sql import functions as F

from groma.streaming import monitor

START = 100_000.0
FINDING = "fingerprint string, clock double, kind string, above boolean"


def played(spark, tmp_path, make, schema, batches):
    """Each batch is a file of its own; the stream is restarted from its checkpoint before every one."""
    for i, rows in enumerate(batches):
        # the watermark begins at zero, where nothing may lie before it
        rows = [tuple(x + START if isinstance(x, float) else x for x in r) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        monitor.run_available(make(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        yield i, spark.read.parquet(f"{tmp_path}/out")


def states(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").count()


@pytest.fixture
def mind(spark):
    """The store that a session had is put back."""
    before = spark.conf.get(monitor.PROVIDER, None)
    yield
    if before is None:
        spark.conf.unset(monitor.PROVIDER)
    else:
        spark.conf.set(monitor.PROVIDER, before)


def test_an_episode_without_input_is_interrupted_and_its_state_ends(spark, tmp_path, mind):
    make = lambda s: monitor.monitored(s, allowed=20, visible_after=5, critical_after=15, quiet=60, keep=600, delay="1 second")
    batches = [
        [("a", float(t), "F", True) for t in range(0, 21, 10)] + [("b", 0.0, "F", False), ("b", 10.0, "C", False)],
        [("c", 50.0, "C", False)],
        [("c", 200.0, "C", False)],
        [("c", 300.0, "C", False)],
        [("c", 2000.0, "C", False)],
        [("c", 2100.0, "C", False)],
        [("a", 2200.0, "F", False)],
    ]
    seen = {}
    for i, out in played(spark, tmp_path, make, FINDING, batches):
        seen[i] = {(r.fingerprint, r.first_seen - START): (r.status, r.last_seen - START, r.severity) for r in monitor.latest(out, ["fingerprint", "first_seen"]).collect()}
        if i == 0:
            assert states(spark, tmp_path, "alert") == 2
    assert seen[0] == {("a", 0.0): ("open", 20.0, "critical"), ("b", 0.0): ("resolved", 10.0, "warning")}
    assert seen[1] == seen[0]
    assert seen[3][("a", 0.0)] == ("interrupted", 20.0, "critical") and seen[3][("b", 0.0)] == seen[0][("b", 0.0)]
    assert states(spark, tmp_path, "alert") <= 2
    assert seen[6][("a", 2200.0)] == ("unknown", 2200.0, "warning") and seen[6][("a", 0.0)] == seen[3][("a", 0.0)]


def test_runs_close_after_a_quiet_minute_and_attempts_go_on(spark, tmp_path, mind):
    make = lambda s: monitor.runs(s, quiet=60, keep=5000, delay="1 second")
    batches = [[("s", 0.0), ("s", 30.0), ("s", 100.0)], [("t", 110.0)], [("t", 400.0)], [("t", 500.0)], [("s", 510.0), ("s", 520.0)], [("u", 20_000.0)], [("u", 30_000.0)], [("u", 40_000.0)]]
    for i, out in played(spark, tmp_path, make, "source string, clock double", batches):
        if i == 3:
            got = {(r.source, r.attempt): (r.samples, r.closed) for r in monitor.latest(out, ["source", "attempt"]).collect()}
            assert got == {("s", 1): (2, True), ("s", 2): (1, True), ("t", 1): (1, True), ("t", 2): (1, True), ("t", 3): (1, False)}
        if i == 4:
            last = monitor.latest(out, ["source", "attempt"]).filter("source = 's' and attempt = 3").first()
            assert (last["first"] - START, last["last"] - START, last.samples, last.closed) == (510.0, 520.0, 2, False)
    kept = {r.key.source for r in spark.read.format("statestore").option("stateVarName", "run").load(f"{tmp_path}/state").collect()}
    assert kept == {"u"}


def test_projects_tick_at_their_own_intervals(spark, tmp_path, mind):
    schema = "project_id string, source string, clock double"
    spark.createDataFrame([("p", "s", 1.0), ("q", "s", 2.0), ("q", "s", 3.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    found = monitor.start_projects(stream, lambda df: monitor.runs(df), {"p": 0.5, "q": 1.0}, str(tmp_path))
    try:
        for query in found.values():
            query.processAllAvailable()
        time.sleep(0.1)
        counts = {p: monitor.latest(spark.read.schema(monitor.RUNS).parquet(f"{tmp_path}/{p}/out"), ["source", "attempt"]).agg(F.sum("samples")).first()[0] for p in found}
        assert counts == {"p": 1, "q": 2} and all(q.isActive for q in found.values())
    finally:
        for query in found.values():
            query.stop()


def test_a_new_key_asks_the_store_for_no_timers():
    """Each call goes through a socket; a key without state has no timer that could be listed."""
    import pandas as pd

    class Store:
        """A handle and its one value."""

        def __init__(self):
            self.value, self.timers, self.listed = None, [], 0

        getValueState = lambda self, name, schema: self  # noqa: E731, N815
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        deleteTimer = lambda self, at: self.timers.remove(at)  # noqa: E731, N815
        registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815

        def update(self, value):
            self.value = value

        def listTimers(self):  # noqa: N802
            self.listed += 1
            return list(self.timers)

    store = Store()
    processor = monitor.EpisodeProcessor(allowed=20, visible_after=5, critical_after=15, quiet=60, keep=600, unit=1.0)
    processor.init(store)
    parts = [pd.DataFrame({"clock": [10.0, 0.0], "kind": ["F", "F"], "above": [True, True]}), pd.DataFrame({"clock": [], "kind": [], "above": []}), pd.DataFrame({"clock": [20.0], "kind": ["C"], "above": [False]})]
    (got,) = processor.handleInputRows(("a",), iter(parts), None)
    assert got[["first_seen", "last_seen", "status"]].values.tolist() == [[0.0, 20.0, "resolved"]]
    assert (store.listed, store.timers) == (0, [80_000])
    list(processor.handleInputRows(("a",), iter(parts[2:]), None))
    assert (store.listed, store.timers) == (1, [80_000])
