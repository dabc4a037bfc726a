"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groma.sources.scratch import forget, written


def components(edges: DataFrame) -> DataFrame:
    """node, root of the graph of edges a, b: the smallest node of each component.

    Each round every node joins its smallest neighbour, twice over, and the graph shrinks to
    the edges between the roots, so later rounds are small. Nodes without an edge to another
    one are not returned. Each round is written to the shared folder.
    """
    mapping, rest = None, edges
    while True:
        ways = written(rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
        if ways.isEmpty():
            break
        up = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
        twice = written(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select(F.col("a").alias("node"), F.col("top").alias("root")), "roots")
        mapping = twice if mapping is None else followed(mapping, twice)
        before, rest = ways, written(renamed(ways, twice).filter("a != b").distinct(), "edges")
        forget(before)
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def followed(mapping: DataFrame, roots: DataFrame) -> DataFrame:
    """mapping's roots replaced by what roots maps them to."""
    return mapping.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def renamed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges a, b between the roots of their ends."""
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
