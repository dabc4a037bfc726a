"""Replays of a stream: a run that is restarted sends rows again that have been taken already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def unique_rows(stream: DataFrame, *, keys: Sequence[str], time: str, within: str) -> DataFrame:
    """The first of each key. Keys are forgotten once the watermark is ``within`` past them, so that state stays bounded."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs over what there is, and returns what has been written."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
