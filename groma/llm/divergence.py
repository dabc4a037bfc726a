"""How the use of terms diverges between sources, by language.

Rows are laid out by (lang, term), sorted by (lang, term, source, document) and scanned in
one pass: each run of a term gives its document frequency and its count in each source. A
task sums up its own documents before, so a row of the shuffle stands for a range of
documents (``docs`` of them, the first being ``document``), and a term that is in a third
of all documents has a few rows of each task. Runs of terms that are kept are scanned a
second time, beside their groups' totals, and emit partial pairs of sources and terms.

A pair's value is a sum over all kept terms, but a run holds only the sources that have
the term. So what is summed are corrections: terms that neither source has give the same
value each, terms of one source depend on its count alone (a histogram of counts does), and
runs add what pairs of sources that share a term differ from both. A run has one row for
each source that has the term; pairs are worked out in blocks, so memory follows the number
of sources, never that of documents. All arithmetic is in whole numbers.

Defined results: null text, lang and source are empty texts; each row is a document,
repeated rows too; a group without terms has pairs with all other sources of its lang; a
lang without kept terms has values of 0; a lang with one source has no pairs; an empty table
gives an empty result; columns beyond those three are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import empty_if_null, scratch, table
from .terms import LETTERS, arrow_texts, term_lists

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Distinct terms that a task holds before it emits them; pairs in a block.
HELD, BLOCK = 400_000, 1_000_000
PARTIAL = "lang string, term string, source string, document long, docs long, count long"
KEPT = "lang string, term string, source string, count long, opens boolean"
FOUND = "lang string, source string, item string, is_pair boolean, value long"


def partial_runs(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, source, document, docs, count: for each task's documents, one row for each (lang, term, source), at times more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter, int]] = {}
        held, number = 0, 0
        for batch in batches:
            for body, *key in zip(arrow_texts(batch.column(2)), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tuple(key) not in groups:
                    groups[tuple(key)] = Counter(), Counter(), number
                counts, docs, _ = groups[tuple(key)]
                held -= len(counts)
                seen: set[bytes] = set()
                for terms in term_lists(body, LETTERS):
                    counts.update(terms)
                    seen.update(terms)
                docs.update(seen)
                held += len(counts)
                number += 1
                if held >= HELD:
                    yield from sorted_rows(groups)
                    groups, held = {}, 0
        yield from sorted_rows(groups)

    read = docs.select(empty_if_null(F.col(lang)).alias("lang"), empty_if_null(F.col(source)).alias("source"), empty_if_null(F.col(text)).alias("text"))
    return read.mapInArrow(work, PARTIAL)


def sorted_rows(groups: dict[tuple[str, str], tuple[Counter, Counter, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs, first) in groups.items():
        if counts:
            terms = sorted(counts)
            n = len(terms)
            whole = lambda values: pa.array(np.fromiter(values, np.int64, n))
            columns = [pa.repeat(lang, n), pa.array(terms, pa.binary()).cast(pa.string()), pa.repeat(source, n), pa.repeat(pa.scalar(first, pa.int64()), n)]
            columns += [whole(map(docs.__getitem__, terms)), whole(map(counts.__getitem__, terms))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARTIAL.split(", ")])


def changes(batch: pa.RecordBatch, names: list[str], before: tuple | None) -> np.ndarray:
    """For each row of a sorted batch whether it differs from the row before it in any of the columns; before: the last row of the batch before."""
    differs = np.zeros(batch.num_rows, bool)
    for i, name in enumerate(names):
        column = batch.column(name)
        differs[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)))
        differs[0] |= before is None or column[0].as_py() != before[i]
    return differs


def kept_runs(partials: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, count of the terms in at least so many documents; opens: the first row of its term's run.

    Rows of a run wait until its documents suffice, which they do after ``least_docs`` rows.
    """
    key = ["lang", "term", "source"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Run(least_docs)
        for batch in batches:
            if batch.num_rows:
                yield from state.take(batch)
        yield from state.end()

    placed = partials.repartition("lang", "term").sortWithinPartitions(*key, "document")
    return placed.mapInArrow(work, KEPT)


class Run:
    """The scan of sorted partial rows: sums rows of the same source, and lets runs through whose documents suffice."""

    def __init__(self, least_docs: int):
        self.least, self.open, self.passed = least_docs, None, False

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            batch = pa.Table.from_batches([self.open, batch]).combine_chunks().to_batches()[0]
        term, row = changes(batch, ["lang", "term"], None), changes(batch, ["lang", "term", "source"], None)
        begins = np.flatnonzero(row)
        merged = batch.take(pa.array(begins))
        for name in ("docs", "count"):
            sums = np.add.reduceat(batch.column(name).to_numpy(), begins)
            place = merged.schema.get_field_index(name)
            merged = merged.set_column(place, merged.schema.field(place), pa.array(sums))
        # the last run stays open: all of it while its documents do not suffice, else its last source
        starts = np.flatnonzero(term[begins])
        docs = np.add.reduceat(merged.column("docs").to_numpy(), starts)
        run = np.cumsum(term[begins]) - 1
        enough = docs >= self.least
        opens = term[begins]
        if self.passed:
            # the first run began in an earlier batch and was let through
            enough[0], opens[0] = True, False
        last = len(begins) - 1 if enough[-1] else starts[-1]
        out = enough[run]
        out[last:] = False
        yield self.rows(merged, opens, out)
        self.open = merged.slice(last)
        self.passed = bool(enough[-1]) and bool(last > starts[-1] or (len(starts) == 1 and self.passed))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            out = np.full(self.open.num_rows, self.passed or sum(self.open.column("docs").to_pylist()) >= self.least)
            opens = np.arange(self.open.num_rows) == 0
            yield self.rows(self.open, opens & (not self.passed), out)

    @staticmethod
    def rows(merged: pa.RecordBatch, opens: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
        columns = [merged.column(n) for n in ("lang", "term", "source", "count")] + [pa.array(opens)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "count", "opens"]).filter(pa.array(out))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact: in Python's whole numbers where 64 bits would not do."""
    if len(count) and int(count.max()) + 1 < 2**63 // SCALE:
        return 1 + SCALE * (count + 1) // total
    return (1 + SCALE * (count.astype(object) + 1) // total.astype(object)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Blocks:
    """The scan of kept runs: terms of groups above their lang's share, and corrections of pairs, summed in the task."""

    def __init__(self) -> None:
        self.code: dict[tuple[str, str], int] = {}
        self.sums: dict[tuple[int, int], int] = defaultdict(int)

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        lang, source = (batch.column(n).dictionary_encode() for n in ("lang", "source"))
        both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        found, own = np.unique(both, return_inverse=True)
        names = [(lang.dictionary[int(x) // len(source.dictionary)].as_py(), source.dictionary[int(x) % len(source.dictionary)].as_py()) for x in found]
        return np.array([self.code.setdefault(n, len(self.code)) for n in names], np.int64)[own]

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """batch: whole runs."""
        count, size, all_size, kinds = (batch.column(n).to_numpy() for n in ("count", "size", "all_size", "kinds"))
        starts = np.flatnonzero(changes(batch, ["lang", "term"], None))
        sizes = np.diff(np.append(starts, batch.num_rows))
        p, p0, code = share(count, size + kinds), share(np.zeros_like(count), size + kinds), self.codes(batch)
        q = share(np.repeat(np.add.reduceat(count, starts), sizes), all_size + kinds)
        above = np.flatnonzero(p > q)
        part = batch.take(pa.array(above))
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), part.column("term"), pa.repeat(False, len(above)), pa.array(distance(p, q)[above])], [x.split()[0] for x in FOUND.split(", ")])
        self.pair(p, p0, code, starts, sizes)
        if len(self.sums) >= HELD:
            yield from self.end()

    def pair(self, p: np.ndarray, p0: np.ndarray, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Every row of a run beside every other row of it, block by block."""
        first, others = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        done = np.cumsum(others)
        low = 0
        while low < len(others):
            behind = done[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(done, behind + BLOCK, "right")))
            n = others[low:high]
            a = np.repeat(np.arange(low, high), n)
            b = np.repeat(first[low:high], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            apart = a != b
            a, b = a[apart], b[apart]
            value = distance(p[a], p[b]) - distance(p[a], p0[b]) - distance(p0[a], p[b]) + distance(p0[a], p0[b])
            keys, own = np.unique(code[a] * len(self.code) + code[b], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, own, value)
            for key, x in zip(keys.tolist(), sums.tolist(), strict=True):
                self.sums[divmod(key, len(self.code))] += x
            low = high

    def end(self) -> Iterator[pa.RecordBatch]:
        names = list(self.code)
        rows = [(*names[a], names[b][1], True, x) for (a, b), x in self.sums.items()]
        self.sums.clear()
        if rows:
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def partial_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, is_pair, value: terms above their lang's share, and partial corrections of pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, open_ = Blocks(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if open_ is not None:
                batch = pa.Table.from_batches([open_, batch]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(changes(batch, ["lang", "term"], None))[-1])
            if last:
                yield from scan.take(batch.slice(0, last))
            open_ = batch.slice(last)
        if open_ is not None:
            yield from scan.take(open_)
        yield from scan.end()

    rows = kept.select("lang", "term", "source", "count").join(totals, ["lang", "source"])
    placed = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return placed.select("lang", "term", "source", "count", "size", "all_size", "kinds").mapInArrow(work, FOUND)


def exact_share(count: Column, total: Column) -> Column:
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 1), whole(total)).cast("long")


def exact_distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def totals_of(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, size (N), all_size (the lang's N), kinds (V): one row for each group, also those without a kept term."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("all_size"), F.count_if("opens").alias("kinds"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("size", "all_size", "kinds")))


def pair_bases(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Values of pairs as if no term were shared: of terms that neither has, and, by the count, of terms that one of them has."""
    a, b = totals.select("lang", "source", "size", "kinds"), totals.select("lang", F.col("source").alias("item"), F.col("size").alias("other_size"))
    pairs = a.join(b, "lang").filter((F.col("source") != F.col("item")) & (F.col("kinds") > 0))
    zero = F.lit(0).cast("long")
    own, other = F.col("size") + F.col("kinds"), F.col("other_size") + F.col("kinds")
    p0, q0 = exact_share(zero, own), exact_share(zero, other)
    shares = pairs.select("lang", "source", "item", "kinds", own.alias("own"), p0.alias("p0"), q0.alias("q0"))
    neither = shares.select("lang", "source", "item", (F.col("kinds") * exact_distance(F.col("p0"), F.col("q0"))).alias("value"))
    counts = kept.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n"))
    p = exact_share(F.col("count"), F.col("own"))
    alone = shares.join(counts, ["lang", "source"]).withColumn("p", p)
    off = F.col("n") * (exact_distance(F.col("p"), F.col("q0")) - exact_distance(F.col("p0"), F.col("q0")))
    back = F.col("n") * (exact_distance(F.col("q0"), F.col("p")) - exact_distance(F.col("q0"), F.col("p0")))
    sums = alone.groupBy("lang", "source", "item").agg(F.sum(off).alias("off"), F.sum(back).alias("back"))
    there = sums.select("lang", "source", "item", F.col("off").alias("value"))
    return neither.unionByName(there).unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = scratch(kept_runs(partial_runs(docs, text=text, lang=lang, source=source), least_docs), "runs")
    groups = docs.select(empty_if_null(F.col(lang)).alias("lang"), empty_if_null(F.col(source)).alias("source")).distinct()
    totals = scratch(totals_of(kept, groups), "totals")
    found = scratch(partial_values(kept, totals), "values")
    every = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item"))
    parts = every.withColumn("value", F.lit(0).cast("long")).unionByName(pair_bases(kept, totals)).unionByName(found.filter("is_pair").drop("is_pair"))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    terms = found.filter(~F.col("is_pair")).drop("is_pair")
    return out(pairs, "pair").unionByName(out(terms, "term").filter(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.size + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.size + l.v)::HUGEINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
