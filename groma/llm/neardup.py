"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with equal shingle sets form a class. Each class is posted under every pair of
coordinate and minimum of its signature. Linked sets agree in at least ``MATCHES``
coordinates, so they meet under the shortest lists of both (prefix); the longest lists
(passages that many documents quote) are skipped, and what a pair shares in them is counted
by merging the two signatures. A class with fewer than ``MATCHES`` lists of two or more is
out at once.

A long list is not expanded into all its pairs. In each of ``ROUNDS`` rounds the most
central class of a list is its hub, and the others meet the hub only; those deep in its
neighbourhood leave the list. Links between two members of a neighbourhood are found by
their differences from the hub: linked sets share a known number of difference tokens, so
they meet under one of the rarest of them (prefix again, by bands of the difference's size,
so that a group of near copies costs its members and not its pairs). Lists that still hold
two classes after the rounds are long by chance: their members share a passage and little
else. These classes are posted anew, under ``BANDS`` lists of ``ROWS`` coordinates together,
which hardly any but similar ones share, and the rounds go on there until no list is left.
Pairs are retained from ``MATCHES`` collisions on, and confirmed on full sets.

The chance that a link at the threshold shows fewer than MATCHES of COORDINATES equal
minima is 6e-7, and that it meets in none of the bands 2e-9; all other steps are exact, but
for 64-bit hashes of shingles and classes:
what is linked to a class deep in a hub's neighbourhood is, by the triangle inequality of
the Jaccard distance, inside the neighbourhood.

Defined results: null and empty texts have no shingles and are linked with nothing; texts
of fewer words than a shingle are one shingle; equal ids are one node's name, each of their
rows with its own text; null ids name nothing and a component of only such rows has a null
id, its rows kept; an empty table gives an empty result; columns beyond id and text are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groma.operators.graphs import components, followed, renamed
from groma.sources.scratch import forget

from .common import LOWER, UPPER, scratch, table

SHINGLE, COORDINATES, MATCHES = 5, 32, 16
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members of a hub's neighbourhood, and those deep in it: with d = 1 - similarity, what is linked to one with d <= 0.8 has d <= 0.95.
MEMBER, DEEP = 0.05, 0.20
#: Rounds of hubs in lists of one coordinate, before the classes that are left are posted under bands.
ROUNDS = 3
BANDS, ROWS = 64, 8
#: Width of a band of difference sizes, as a part of the hub's size.
BAND = 0.04
SEED = 5
#: A list of at most this many numbers (some 16 MB) is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def by_sorting(rows: DataFrame) -> DataFrame:
    """A table that grows with the documents is never broadcast: Spark goes by the bytes of its files, and rows that repeat a class or a token take many times that."""
    return rows.hint("merge")



class Shingler:
    """Hashed shingle sets and their signatures. Hashes of words are remembered up to a bound."""

    def __init__(self, shingle: int, coordinates: int):
        rng = np.random.default_rng(SEED)
        self.shingle = shingle
        self.multiply = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
        self.word = re.compile(r"[^\x20\x09-\x0D]+")
        self.lower = str.maketrans(UPPER, LOWER)
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes."""
        known, hashes = self.known, []
        for w in self.word.findall(text.translate(self.lower)):
            h = known.get(w)
            if h is None:
                if len(known) >= 500_000:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        if not hashes:
            return np.empty(0, np.uint64)
        x = np.array(hashes, np.uint64)
        wide = min(self.shingle, len(x))
        mixed = np.full(len(x) - wide + 1, wide, np.uint64)
        for i in range(wide):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - wide + 1 + i]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.multiply), 0xFFFFFFFF, np.uint64)
        for start in range(0, len(shingles), 4096):
            part = shingles[start : start + 4096]
            values = (part[:, None] * self.multiply[None] + self.add[None]) >> np.uint64(32)
            np.minimum(least, values.min(axis=0), out=least)
        return least

    def postings(self, shingles: np.ndarray) -> np.ndarray:
        """One number for each coordinate and its minimum."""
        least = self.minima(shingles)
        return (np.arange(len(least), dtype=np.uint64) << np.uint64(32) | least).astype(np.int64)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """One number for each band of ROWS coordinates and their minima."""
        least = self.minima(shingles).reshape(-1, ROWS)
        mixed = np.arange(1, len(least) + 1, dtype=np.uint64)
        for i in range(ROWS):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + least[:, i]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        return mixed.astype(np.int64)


def class_of(shingles: np.ndarray) -> int:
    """A class's number, from its whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, cls (null without shingles), n, postings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(SHINGLE, COORDINATES)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [own.shingles(x.as_py() or "") for x in part.column(1)]
                columns = [
                    part.column(0),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([own.postings(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "cls", "n", "postings"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, cls long, n long, postings array<long>")


def packed(postings: np.ndarray) -> list[int]:
    """The low eight bits of each minimum, eight to a number: equal minima have equal bits."""
    return [int(x) for x in (postings & 0xFF).astype(np.uint8).view(np.int64)]


def agreeing(a: str, b: str) -> Column:
    """Coordinates in which two packed signatures have equal bits: at least those with equal minima."""
    total = F.lit(0)
    for i in range(COORDINATES // 8):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def full_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """cls, s, sig: sets and packed signatures of the classes in wanted. Only documents that stand for one of them are read again."""
    wanted = scratch(wanted, "wanted")
    stand_in = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("one"))
    ids = scratch(stand_in.select(F.col("one.id").alias("_id")).distinct(), "stand-ins")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))
    some = docs.select(F.col(doc_id), F.col(text).alias("text")).join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, same, "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(SHINGLE, COORDINATES)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [s for x in batch.column(0).slice(start, 500) if len(s := own.shingles(x.as_py() or ""))]
                columns = [
                    pa.array([class_of(s) for s in sets], pa.int64()),
                    pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([packed(own.postings(s)) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "s", "sig"])

    found = some.select("text").mapInArrow(work, "cls long, s array<long>, sig array<long>")
    sets = scratch(found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    forget(wanted, ids)
    return sets


def posted(lists: DataFrame) -> DataFrame:
    """cls, token, pop: the lists under which a class must meet whatever it is linked to.

    Linked classes share MATCHES of COORDINATES lists. Lists of one are the shortest of all and
    come first in every class's order, so k longer ones leave the k - MATCHES + 1 shortest of them
    as the prefix; the longest lists (passages that many documents quote) are skipped. pop, the
    length of all lists of a class together, tells how central it is.
    """
    # written: a list that a third of all classes have is then a skewed join, which Spark splits
    lengths = scratch(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lengths")
    own = Window.partitionBy("cls")
    shared = lists.join(by_sorting(lengths), "token").withColumn("k", F.count(F.lit(1)).over(own)).withColumn("pop", F.sum("n").over(own))
    placed = shared.withColumn("place", F.row_number().over(own.orderBy("n", "token")))
    return placed.filter(F.col("place") <= F.col("k") - MATCHES + 1).select("cls", "token", "pop")


def starred(lists: DataFrame) -> DataFrame:
    """cls, token, pop, hub: the most central class of each list of two or more. Lists and hubs are written, so that long lists are split in the join."""
    lists = scratch(lists, "lists")
    hubs = scratch(lists.groupBy("token").agg(F.max(F.struct("pop", "cls"))["cls"].alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "hubs")
    stars = scratch(lists.join(by_sorting(hubs), "token").select("cls", "token", "pop", "hub"), "stars")
    forget(lists, hubs)
    return stars


def banded(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, token, pop: the classes under their bands, as ``posted`` gives them for single coordinates; lists of one go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(SHINGLE, BANDS * ROWS)
        for batch in batches:
            found = [own.bands(x.values.to_numpy().view(np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["cls", "tokens"])

    some = sets.select("cls", "s").join(classes, "cls", "left_semi")
    lists = scratch(some.mapInArrow(work, "cls long, tokens array<long>").select("cls", F.explode("tokens").alias("token")), "bands")
    lengths = scratch(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lengths")
    return lists.join(by_sorting(lengths), "token").withColumn("pop", F.sum("n").over(Window.partitionBy("cls"))).select("cls", "token", "pop")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, hub -> also sig, na, np, both (size of the intersection) and delta (the tokens in one of the sets only); MEMBER pairs only."""
    a = pairs.join(sets, "cls")
    b = a.join(sets.select(F.col("cls").alias("hub"), F.col("s").alias("ps")), "hub")
    sized = b.withColumn("na", F.size("s")).withColumn("np", F.size("ps")).filter(F.least("na", "np") >= F.greatest("na", "np") * MEMBER)
    met = sized.withColumn("both", F.size(F.array_intersect("s", "ps")))
    near = met.filter(F.col("both") >= (F.col("na") + F.col("np") - F.col("both")) * MEMBER)
    return near.select("cls", "hub", "sig", "na", "np", "both", F.concat(F.array_except("s", "ps"), F.array_except("ps", "s")).alias("delta"))


def linked(both: Column, a: Column, b: Column) -> Column:
    return both * 100 >= (a + b - both) * PERCENT


def completed(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Further links a, b within hubs' neighbourhoods, between different components so far.

    With c = (100 - PERCENT) / (100 + PERCENT), sets a and b are linked if and only if their
    differences from a hub share at least (|Da| + |Db| - c(|a| + |b|)) / 2 tokens, and then
    |Da| and |Db| differ by c(|a| + |b|) at most. Members are dealt to bands of |D|; for each
    band that a partner can be in, a member is posted under as many of its rarest tokens as
    the smallest difference of that band asks for. Pairs of which both are linked to the hub
    are connected already; of the others, those that meet within the prefixes of their exact
    sizes and collide in MATCHES coordinates are compared in full.
    """
    c = (100 - PERCENT) / (100 + PERCENT)
    member = near.filter(F.size("delta") > 0).withColumn("far", ~linked(F.col("both"), F.col("na"), F.col("np"))).withColumn("d", F.size("delta"))
    mixed = member.groupBy("hub").agg(F.bool_or("far").alias("any"), F.count(F.lit(1)).alias("m")).filter("any and m > 1").select("hub")
    member = member.join(mixed, "hub", "left_semi").withColumn("member", F.xxhash64("hub", "cls"))
    # a token of a neighbourhood and a member are one number each
    tokens = member.select("member", "hub", F.explode("delta").alias("t")).select("member", F.xxhash64("hub", "t").alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(by_sorting(counted), "token")
    width = F.greatest(F.lit(1), F.ceil(F.col("np") * BAND)).cast("int")
    facts = member.select("member", "hub", "cls", "sig", "na", "np", "d", "far", width.alias("w")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # tokens that no other member has are the rarest and fill the prefix first: places count from the end
    placed = shared.withColumn("left", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("df"), F.desc("token")))).drop("df").join(facts, "member")
    # a place with so many tokens left, its own included, is in the prefix for a partner from whose difference left >= need follows
    slack = F.col("na") * (c * (1 + 100 / PERCENT))
    own = F.floor(F.col("d") / F.col("w")).cast("int")
    least_far = F.when(F.col("far"), F.lit(0)).otherwise(F.floor(c * (F.col("na") * (PERCENT / 100) + F.col("np")) / F.col("w")).cast("int"))
    low = F.greatest(F.floor((F.col("d") - slack) / F.col("w")).cast("int"), least_far, F.lit(0))
    # the place counts for partners whose difference is at most 2 * left - d + slack
    high = F.floor(F.least(2 * F.col("left") - F.col("d") + slack + 1e-6, F.col("d") + slack) / F.col("w")).cast("int")
    reach = placed.withColumn("own", own).withColumn("low", low).withColumn("high", high).filter("low <= high").drop("member")
    reach = scratch(reach, "prefixes")
    bands = lambda a, b: F.explode(F.sequence(a, b))
    up = reach.filter("high >= own").withColumn("other", bands(F.greatest("low", "own"), F.col("high")))
    down = reach.filter("low <= own").withColumn("other", bands(F.col("low"), F.least("high", "own")))
    keep = ("hub", "cls", "root", "sig", "na", "d", "far", "left")
    x = up.select("token", F.col("own").alias("lower"), F.col("other").alias("upper"), *[F.col(k).alias(f"x_{k}") for k in keep])
    y = down.select("token", F.col("other").alias("lower"), F.col("own").alias("upper"), *[F.col(k).alias(f"y_{k}") for k in keep if k != "hub"])
    need = (F.col("x_d") + F.col("y_d") - c * (F.col("x_na") + F.col("y_na"))) / 2 - 1e-6
    once = (F.col("lower") < F.col("upper")) | (F.col("x_cls") < F.col("y_cls"))
    apart = (F.col("x_root") != F.col("y_root")) & (F.col("x_far") | F.col("y_far"))
    sized = (F.least("x_na", "y_na") * 100 >= F.greatest("x_na", "y_na") * PERCENT) & (need <= F.least("x_left", "y_left"))
    met = x.join(by_sorting(y), ["token", "lower", "upper"]).filter(apart & once & sized & (agreeing("x_sig", "y_sig") >= MATCHES))
    pairs = met.groupBy(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).agg(F.min("x_hub").alias("hub"))
    side = lambda n: member.select("hub", F.col("cls").alias(n), F.col("na").alias(f"n{n}"), F.col("delta").alias(f"d{n}"))
    both = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    difference = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    links = scratch(both.filter(linked((F.col("na") + F.col("nb") - difference) / 2, F.col("na"), F.col("nb"))).select("a", "b"), "completed")
    forget(reach)
    return links


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows = scratch(signed(docs, doc_id, text), "signed")
    classes = rows.filter("n > 0").groupBy("cls").agg(F.first("postings").alias("postings"))
    stars = starred(posted(classes.select("cls", F.explode("postings").alias("token"))))
    members = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    near, sets = None, None
    rounds = 0
    while not stars.isEmpty():
        rounds += 1
        sets = full_sets(docs, rows, stars.select("cls").distinct(), doc_id, text) if sets is None else sets
        found = scratch(confirmed(stars.filter("cls != hub").select("cls", "hub").distinct(), sets), "confirmed")
        near = found if near is None else near.unionByName(found)
        deep = found.filter(F.col("both") >= (F.col("na") + F.col("np") - F.col("both")) * DEEP).select("cls", "hub")
        rest = stars.filter("cls != hub").join(by_sorting(deep), ["cls", "hub"], "left_anti").select("cls", "token", "pop")
        before, stars = stars, starred(rest)
        forget(before)
        if rounds == ROUNDS and not stars.isEmpty():
            # every list has lost a hub in each round, so that the rounds end
            before, stars = stars, starred(banded(stars.select("cls").distinct(), sets))
            forget(before)
    if near is None:
        names = members.select("cls", F.col("first").alias("component_id"))
    else:
        roots = components(near.filter(linked(F.col("both"), F.col("na"), F.col("np"))).select(F.col("cls").alias("a"), F.col("hub").alias("b")))
        tops = components(renamed(completed(near, roots), roots))
        rooted = followed(followed(members.select(F.col("cls").alias("node"), F.col("cls").alias("root")), roots), tops).withColumnRenamed("node", "cls").join(by_sorting(members), "cls")
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        names = rooted.join(by_sorting(least), "root").select("cls", "component_id")
    joined = rows.select("doc_id", "cls", F.col("n").alias("n_shingles")).join(by_sorting(names), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
