"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``functions`` random projections into intervals of one
width; the interval numbers are the bucket. For a query, the chance that a neighbour lies a
given number of intervals away follows from the query's place in its own interval and the
usual distance of neighbours, learned from a few vectors of a bounded sample by comparing
them with all. Intervals are ``width`` times that distance wide. Buckets are visited in the
order of the product of these chances until they add up to ``success``. What the tables find
is merged and ranked by exact distance.

The usual distance only says where to begin: it is small where many vectors are copies of each
other, whatever the distances of the rest. So each query then goes by its own k-th candidate:
if that is farther than the usual distance, the buckets that hold ``success`` of the vectors at
the candidate's distance are visited too.

Buckets are packed and packs split into blocks of bounded size on both sides, so a bucket with
a third of all vectors is many tasks, and only each block's best k of a query leave it. A query for which
fewer than k are found, or whose k-th candidate is too far for the buckets in reach, is compared
with all vectors, in blocks.

Defined results: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part; ties go to the smaller id; repeated rows count
once; with fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import erf, exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

K, TABLES, FUNCTIONS, WIDTH, REACH, SUCCESS, SEED = 10, 2, 12, 3.0, 2, 0.75, 17
#: Buckets that a query visits in one table at most; one that would need more is compared with all vectors.
MOST_PROBES = 2000
#: Rows of the sample that scale and distances are learned from; most vectors and queries in one block.
SAMPLE_ROWS, BLOCK_VECTORS, BLOCK_QUERIES = 2000, 4000, 1000
#: Vectors whose neighbours are searched among all, to learn the usual distance.
GAUGES = 64
#: Queries whose buckets one task looks up.
PROBE_ROWS = 64
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter(v.isNotNull() & F.col(vec_id).isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


class Hashes:
    """Projections, offsets and widths, the same on every executor."""

    def __init__(self, sample: np.ndarray, near: float, tables: int, functions: int, width: float, reach: int, success: float, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.a = rng.standard_normal((tables, dim, functions))
        spread = float(np.mean([np.std(sample @ a) for a in self.a])) or 1.0
        middle = np.stack([np.median(sample @ a, axis=0) for a in self.a])
        self.near = max(near, 1e-3 * spread)
        self.w = width * self.near
        self.b = rng.uniform(0, self.w, (tables, functions)) - middle
        self.reach, self.success, self.functions = reach, success, functions

    def place(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval numbers, and places within the interval in [0, 1)."""
        at = (x @ self.a[t] + self.b[t]) / self.w
        whole = np.floor(at)
        return whole.astype(np.int64), at - whole

    @staticmethod
    def bucket(numbers: np.ndarray) -> np.ndarray:
        """One number for each row of interval numbers."""
        mixed = np.zeros(numbers.shape[:-1], np.int64)
        with np.errstate(over="ignore"):
            for j in range(numbers.shape[-1]):
                mixed = mixed * np.int64(1_000_003) + numbers[..., j]
        return mixed

    def probes(self, x: np.ndarray, t: int, far: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """Buckets to visit for each query, best first, for neighbours at the query's distance ``far``; and whether they hold enough of them."""
        numbers, places = self.place(x, t)
        phi = np.vectorize(lambda z: 0.5 * (1 + erf(z / 2**0.5)))
        scale = (far / self.w)[:, None, None]
        edges = np.arange(-self.reach, self.reach + 2)
        below = phi((edges[None, None, :] - places[:, :, None]) / scale)
        chance = np.diff(below, axis=2)
        found = []
        for i in range(len(x)):
            moves, enough = self.agenda(chance[i])
            found.append((self.bucket(numbers[i] + moves), enough))
        return found

    def agenda(self, chance: np.ndarray) -> tuple[np.ndarray, bool]:
        """Moves by falling chance until these add up to ``success``; false if that takes more than MOST_PROBES.

        chance: functions x intervals. Each function's intervals are ranked; the best move not
        yet visited lies in a heap, and each visited one puts in those that differ from it by
        one rank, in its last changed function or a later one, so none comes twice.
        """
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, axis=1)
        cost = (-np.log(np.maximum(ranked, 1e-300))).tolist()
        heap: list[tuple[float, tuple[int, ...], int]] = [(sum(c[0] for c in cost), (0,) * self.functions, 0)]
        visited: list[tuple[int, ...]] = []
        total = 0.0
        while heap and total < self.success and len(visited) < MOST_PROBES:
            spent, ranks, last = heapq.heappop(heap)
            visited.append(ranks)
            total += exp(-spent)
            for j in range(last, self.functions):
                r = ranks[j] + 1
                if r < len(cost[j]):
                    heapq.heappush(heap, (spent - cost[j][r - 1] + cost[j][r], (*ranks[:j], r, *ranks[j + 1 :]), j))
        picks = np.array(visited)
        return order[np.arange(self.functions)[None, :], picks] - self.reach, total >= self.success


def block_best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k nearest of one block by exact distance, ties to the smaller id."""
    rough = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * queries @ vectors.T
    rough[query_ids[:, None] == vec_ids[None]] = np.inf
    slack = 1e-9 * (1 + float(np.abs(rough[np.isfinite(rough)]).max(initial=0)))
    for i in range(len(queries)):
        own = rough[i]
        bound = np.partition(own, k - 1)[k - 1] + slack if len(own) > k else np.inf
        near = np.flatnonzero((own <= bound) & np.isfinite(own))
        score = np.sqrt(((vectors[near] - queries[i]) ** 2).sum(1))
        best = np.lexsort((vec_ids[near], score))[:k]
        yield np.full(len(best), query_ids[i]), vec_ids[near][best], score[best]


def usual_distance(good: DataFrame, gauges: np.ndarray, k: int) -> float:
    """The median distance from a few vectors of the sample to their k-th neighbours among all vectors. Those among copies, at distance 0, do not count."""

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(gauges), k + 1), np.inf)
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty((0, gauges.shape[1]))
            squares = (gauges**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * gauges @ x.T
            best = np.sort(np.concatenate([best, np.sqrt(np.maximum(squares, 0))], axis=1), axis=1)[:, : k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(gauges), dtype=np.int32), k + 1)), pa.array(best.ravel())], ["gauge", "away"])

    own = Window.partitionBy("gauge").orderBy("away")
    placed = good.mapInArrow(closest, "gauge int, away double").withColumn("place", F.row_number().over(own)).filter(F.col("place") == k + 1)
    found = [r["away"] for r in placed.select("away").collect() if 1e-6 < r["away"] < float("inf")]  # one row for each gauge
    return float(np.median(found)) if found else 0.0


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, reach: int = REACH, success: float = SUCCESS, seed: int = SEED, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    good = usable(vectors, vec_id, embedding)
    most = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.filter(F.size("v") == most["dim"]).dropDuplicates(["vec_id", "v"])
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()
    sample = np.stack(drawn["v"].to_numpy())
    usual = usual_distance(good, np.unique(sample, axis=0)[:: max(1, len(sample) // GAUGES)][:GAUGES], k)
    held = vectors.sparkSession.sparkContext.broadcast(Hashes(sample, usual, tables, functions, width, reach, success, seed))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            for t in range(tables):
                buckets = Hashes.bucket(held.value.place(x, t)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(buckets), batch.column(0), batch.column(1)], ["t", "bucket", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = np.stack(part.column(1).to_numpy(zero_copy_only=False))
                for t in range(tables):
                    for i, (found, _) in enumerate(held.value.probes(x, t, np.full(len(x), held.value.near))):
                        yield visits_of(part, i, t, found)

    def probe_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets that the query's own distance adds; table -1 for a query that has too few in reach."""
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x, far = np.stack(part.column(1).to_numpy(zero_copy_only=False)), part.column(2).to_numpy(zero_copy_only=False)
                for t in range(tables):
                    before = held.value.probes(x, t, np.full(len(x), held.value.near))
                    for i, (found, enough) in enumerate(held.value.probes(x, t, far)):
                        yield visits_of(part, i, t, np.setdiff1d(found, before[i][0])) if enough else visits_of(part, i, -1, np.zeros(1, np.int64))

    stored = scratch(good.mapInArrow(index, "t int, bucket long, vec_id long, v array<double>"), "buckets")
    # a query asks for hundreds of buckets: dealt by number, as Spark would give so few rows to one task
    queries = scratch(good.filter(is_query).select("vec_id", "v"), "queries")
    queries = queries.repartition(max(1, -(-queries.count() // PROBE_ROWS)), "vec_id")
    sizes = scratch(stored.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")
    visits = queries.mapInArrow(probe, "t int, bucket long, query_id long")
    first = best(stored, sizes, visits, queries, k)
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("far"))
    on = queries.join(kth.filter(F.col("far") > held.value.near), "vec_id").select("vec_id", "v", "far")
    on = scratch(on.mapInArrow(probe_on, "t int, bucket long, query_id long"), "visits-on")
    short = scratch(queries.join(kth, "vec_id", "left_anti").select("vec_id").union(on.filter("t < 0").select("query_id")).distinct(), "short")
    more = best(stored, sizes, on.filter("t >= 0").join(short, on["query_id"] == short["vec_id"], "left_anti"), queries, k)
    merged = first.drop("rank").unionByName(more.drop("rank")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    first = ranked(merged, k)
    if short.isEmpty():
        return first
    blocks = max(1, -(-stored.filter("t = 0").count() // BLOCK_VECTORS))
    # written, so that the two sides to be compared are different tables
    dealt = scratch(good.select(F.lit(-1).alias("t"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("bucket"), "vec_id", "v"), "blocks")
    everywhere = short.select(F.lit(-1).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bucket"), F.col("vec_id").alias("query_id"))
    counted = dealt.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"))
    again = best(dealt, counted, everywhere, queries, k)
    return first.join(short, first["query_id"] == short["vec_id"], "left_anti").unionByName(again)


def visits_of(part: pa.RecordBatch, i: int, t: int, buckets: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), t, np.int32)), pa.array(buckets), part.column(0).take(pa.array([i] * len(buckets), pa.int64()))], ["t", "bucket", "query_id"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return scratch(order.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def best(stored: DataFrame, sizes: DataFrame, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in the buckets it visits.

    Buckets are packed, so that a query's vector travels once to each pack with the buckets it
    visits there, and packs are cut into blocks, so that a bucket with a third of all vectors
    is many tasks. Within a block a query is compared with the vectors of its buckets only.
    """
    total = sizes.groupBy("t").agg(F.sum("n").alias("all")).agg(F.max("all")).first()[0] or 0
    packs = max(1, -(-total // BLOCK_VECTORS))
    pack = F.pmod(F.xxhash64("bucket"), F.lit(packs)).cast("int")
    asked = visits.join(sizes, ["t", "bucket"]).withColumn("pack", pack).groupBy("t", "pack", "query_id").agg(F.collect_list("bucket").alias("buckets"))
    asked = scratch(asked, "visits")
    held = sizes.withColumn("pack", pack).groupBy("t", "pack").agg(F.sum("n").alias("n"))
    load = asked.groupBy("t", "pack").agg(F.count(F.lit(1)).alias("m")).join(held, ["t", "pack"])
    load = scratch(load.select("t", "pack", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("vs"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("qs")), "loads")
    share = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(load, ["t", "pack"]).withColumn("q", share("query_id", "qs")).withColumn("p", every("vs"))
    left = left.join(queries.select(F.col("vec_id").alias("query_id"), "v"), "query_id").select("t", "pack", "p", "q", "query_id", "buckets", "v")
    right = stored.withColumn("pack", pack).join(load, ["t", "pack"]).withColumn("p", share("vec_id", "vs")).withColumn("q", every("qs")).select("t", "pack", "p", "q", "bucket", "vec_id", "v")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if a.empty or b.empty:
            return none
        order = np.argsort(b["bucket"].to_numpy(), kind="stable")
        buckets, vec_ids, x = b["bucket"].to_numpy()[order], b["vec_id"].to_numpy()[order], np.stack(b["v"].to_numpy()[order])
        first, begins = np.unique(buckets, return_index=True)
        stops = np.append(begins[1:], len(buckets))
        got = []
        for query_id, asked_for, v in zip(a["query_id"].to_numpy(), a["buckets"], a["v"], strict=True):
            at = np.searchsorted(first, asked_for)
            there = at[(at < len(first)) & (first[np.minimum(at, len(first) - 1)] == asked_for)]
            if len(there):
                own = np.concatenate([np.arange(begins[i], stops[i]) for i in there])
                got += block_best(np.asarray(v)[None], np.array([query_id]), x[own], vec_ids[own], k)
        return pd.DataFrame({n: np.concatenate([g[i] for g in got]) for i, n in enumerate(["query_id", "vec_id", "score"])}) if got else none

    keys = ["t", "pack", "p", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, FOUND)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
