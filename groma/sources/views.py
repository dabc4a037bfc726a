"""The test tables as site data: events as observations and findings, orders as works, line items as detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, run_id, clock (microseconds), class_id, raw_count (null where the frame is unusable), usable."""
    return as_observations(table(spark, sf_dir, "events"))


def as_observations(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    usable = F.col("event_type") != "error"
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("clock"), F.col("event_type").alias("class_id"), F.when(usable, k % 5).alias("raw_count"), usable.alias("usable"))


def findings(observed: DataFrame) -> DataFrame:
    """fingerprint, clock, kind (F: fewer than 2 of 4, C: enough, N: unusable), above (more than 80 % missing)."""
    kind = F.when(~F.col("usable"), "N").when(F.col("raw_count") < 2, "F").otherwise("C")
    return observed.select(F.col("run_id").cast("string").alias("fingerprint"), "clock", kind.alias("kind"), F.coalesce((4 - F.col("raw_count")) / 4 > 0.8, F.lit(False)).alias("above"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, plan_id, starts, ends (days, half-open), status."""
    day = F.unix_date(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("plan_id"), day.alias("starts"), (day + 30).alias("ends"), F.col("o_orderstatus").alias("status"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, row, plan_id, day, class_id, level, score and a box, from each line item."""
    x, y = F.col("l_quantity") / 100, F.col("l_discount") * 5
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 0.2).alias("x2"), (y + 0.1 + F.col("l_tax")).alias("y2"))
    row = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id"), row.alias("row"), F.col("l_partkey").alias("plan_id"), F.unix_date(F.to_date("l_shipdate")).alias("day"), F.col("l_returnflag").alias("class_id"), F.col("l_quantity").cast("long").alias("level"), F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("split"), box.alias("box"))
