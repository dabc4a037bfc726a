"""Settings and states of jobs, sources and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revisions(requests: DataFrame, *, scope: str, order: str, content: str, model: str) -> DataFrame:
    """requests with revision, changed and reset: a request that says what already holds changes nothing, one for another model begins again at 1.

    The scope's requests come in order; each is compared with the one before it, so this is a
    window, not a fold.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(scope).orderBy(order)
    other = ~F.col(model).eqNullSafe(F.lag(model).over(w)) | F.lag(order).over(w).isNull()
    differs = ~F.col(content).eqNullSafe(F.lag(content).over(w)) | other
    marked = requests.withColumn("reset", other).withColumn("changed", differs).withColumn("_epoch", F.sum(F.col("reset").cast("int")).over(w))
    own = Window.partitionBy(scope, "_epoch").orderBy(order)
    return marked.withColumn("revision", F.sum(F.col("changed").cast("int")).over(own)).drop("_epoch")


def analysis_state(status: Column, total: Column, assessed: Column) -> Column:
    """What a job has to show: its own end first, then how many of its observations are assessed."""
    return F.when(status == "failed", "failed").when(total == 0, F.when(status == "completed", "empty").otherwise("waiting")).when(assessed >= total, F.when(status == "completed", "complete").otherwise("running")).when(assessed > 0, "partial").otherwise("waiting")


def results_ready(state: Column) -> Column:
    return state.isin("complete", "partial", "running")


def demo_state(mode: Column, scenario: Column) -> Column:
    """The status that a demonstration shows."""
    return F.when(mode == "offline", "no data").when(scenario == "shortage", "behind").when(scenario == "surplus", F.when(mode == "strict", "check").otherwise("on plan")).otherwise("on plan")


def bound(ids: Column, more: Column) -> Column:
    return F.array_sort(F.array_union(ids, more))


def unbound(ids: Column, fewer: Column) -> Column:
    return F.array_sort(F.array_except(ids, fewer))
