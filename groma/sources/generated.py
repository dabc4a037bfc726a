"""Made-up data: the same rows for the same sources, without any state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observations(sources: DataFrame, *, number: str, samples: int, step: float) -> DataFrame:
    """id, run_id, clock, raw_count and usable: as many samples of each source, ``step`` apart. sources: a row for each, with its number."""
    s, i = F.col(number).cast("long"), F.col("i").cast("long")
    rows = sources.select(number, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    return rows.select((s * samples + i).alias("id"), F.concat(F.lit("source-"), s.cast("string")).alias("run_id"), (i * float(step)).alias("clock"), ((s * 7 + i * 3) % 5).alias("raw_count"), ((s + i) % 11 != 0).alias("usable"))
