"""Sinks that are played twice, crash half way, or meet another writer."""

import pytest
from pyspark.sql import functions as F

from groma.sources import datasets, ledger


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, value string, at long")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def upsert(before, changes):
    return ledger.upserted(before, changes, keys=["id"], order=[F.col("at")], deleted=F.col("value") == "gone")


def test_a_batch_counts_once(spark, tmp_path):
    table = ledger.Versions(spark, f"file://{tmp_path}/t")
    take = ledger.applied(table, "w", upsert)
    first, second = rows(spark, (1, "a", 1), (1, "b", 2), (None, "n", 1), (2, "c", 1)), rows(spark, (2, "gone", 3), (3, "d", 3))
    take(first, 0)
    take(first, 0)
    take(second, 1)
    take(first, 0)
    take(second, 1)
    assert as_set(table.read()) == {(1, "b", 2), (None, "n", 1), (3, "d", 3)}
    assert table.versions() == [1, 2] and table.latest().played == {"w": 1}
    assert as_set(table.read(1)) == {(1, "b", 2), (None, "n", 1), (2, "c", 1)}
    ledger.applied(table, "other", upsert)(rows(spark, (9, "x", 1)), 0)
    assert table.latest().played == {"w": 1, "other": 0} and table.read().count() == 4
    take(rows(spark), 2)
    assert table.read().count() == 4


def test_a_crash_before_the_ledger_line_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch):
    table = ledger.Versions(spark, f"file://{tmp_path}/t")
    take = ledger.applied(table, "w", upsert)
    take(rows(spark, (1, "a", 1)), 0)

    def crash(self, draft, name):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(ledger.Versions, "_renamed", crash)
        take(rows(spark, (2, "b", 2)), 1)
    assert as_set(table.read()) == {(1, "a", 1)} and table.versions() == [1]
    take(rows(spark, (2, "b", 2)), 1)
    assert as_set(table.read()) == {(1, "a", 1), (2, "b", 2)}
    assert table.sweep() == 2 and as_set(table.read()) == {(1, "a", 1), (2, "b", 2)}


def test_of_two_writers_from_one_version_one_meets_a_conflict(spark, tmp_path):
    table = ledger.Versions(spark, f"file://{tmp_path}/t")
    table.commit(rows(spark, (1, "a", 1)), base=0)
    table.commit(rows(spark, (1, "b", 2)), base=1)
    with pytest.raises(ledger.Conflict):
        table.commit(rows(spark, (1, "c", 2)), base=1)
    assert as_set(table.read()) == {(1, "b", 2)}
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")]) == 2
    with pytest.raises(LookupError):
        table.read(7)
    assert table.sweep(keep=1) >= 1 and as_set(table.read()) == {(1, "b", 2)}


def test_a_stream_that_lost_its_checkpoint_changes_nothing(spark, tmp_path):
    rows(spark, (1, "a", 1), (2, "b", 1)).coalesce(1).write.parquet(f"{tmp_path}/in")
    table = ledger.Versions(spark, f"file://{tmp_path}/t")
    for run in ("one", "two"):
        stream = spark.readStream.schema("id long, value string, at long").parquet(f"{tmp_path}/in")
        query = stream.writeStream.foreachBatch(ledger.applied(table, "s", upsert)).option("checkpointLocation", f"{tmp_path}/{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    assert table.versions() == [1] and table.read().count() == 2


LABELS = "split string, name string, content string"


def test_a_data_set_appears_whole(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    df = spark.createDataFrame([("train", f"n{i}", "0 1 2\n1 2 3") for i in range(40)] + [("val", "n0", ""), ("val", "m", None)], LABELS).repartition(4)
    found = datasets.publish(df, path)
    assert found["files"] == {"train": 40, "val": 2} and found["lines"] == {"train": 80, "val": 0}
    assert datasets.label_rows(spark, path).groupBy("split").count().collect()[0]["count"] == 80
    assert [p.name for p in tmp_path.iterdir()] == ["set"]
    with pytest.raises(Exception, match="FileExists|DATA_SOURCE"):
        datasets.publish(df, path)
    assert datasets.publish(df.limit(3), path, overwrite=True)["files"] != found["files"]
    assert [p.name for p in tmp_path.iterdir()] == ["set"]


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    df = spark.createDataFrame([("train", f"n{i}", "0 1 2") for i in range(30)] + [("train", "a/b", "x")], LABELS).repartition(4)
    with pytest.raises(Exception, match="cannot be names"):
        datasets.publish(df, path)
    assert list(tmp_path.iterdir()) == []
    twice = spark.createDataFrame([("train", "n", "1"), ("train", "n", "2")], LABELS)
    with pytest.raises(ValueError, match="more than once"):
        datasets.publish(twice, path)


def test_an_attempt_that_does_not_count_is_removed(tmp_path):
    import pyarrow as pa

    writer = datasets.LabelledSetWriter(f"file://{tmp_path}/set", False)
    batch = pa.RecordBatch.from_pylist([{"split": "train", "name": "n", "content": "1"}])
    writer.write(iter([batch]))  # an attempt that was lost after its files were written
    writer.commit([writer.write(iter([batch])), None])
    assert len(list((tmp_path / "set" / "labels" / "train").iterdir())) == 1
    assert datasets.manifest(f"file://{tmp_path}/set")["files"] == {"train": 1}
