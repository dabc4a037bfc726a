"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without one, local sessions get a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='groma-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, rows_in_file: int = 0) -> DataFrame:
    """df written there and read again: cuts the lineage and survives lost executors.

    rows_in_file: at most so many rows in a file, 0 for no limit. Spark's reader holds up to 4096 rows of a file
    at once, so rows of megabytes need a limit.
    """
    path = f"{shared_folder(df.sparkSession)}/groma-{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_in_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that have been read for the last time: nothing lazily read depends on them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered_parts(df: DataFrame, order: Sequence[str], name: str, part: str = "part") -> DataFrame:
    """df laid out by ranges of the order and written, with the number of each row's range in a column ``part``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), name)


def parts_before(placed: DataFrame, group: str, amount: Column) -> DataFrame:
    """group, part, before (the amount in the group's earlier parts) and total: one row for each group and part, however many rows they hold."""
    sums = placed.groupBy(group, "part").agg(amount.alias("_here"))
    w = Window.partitionBy(group)
    return sums.withColumn("before", F.sum("_here").over(w.orderBy("part")) - F.col("_here")).withColumn("total", F.sum("_here").over(w)).drop("_here")
