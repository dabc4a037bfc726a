"""Ranked lexical search over an inverted index in shards.

``index`` reads whole texts once and gives a row for each shard: its documents, their
numbers of terms, and for each term the documents that hold it and how often. A shard is
full at ``SHARD_POSTINGS`` postings, so its size follows neither texts nor tasks. ``stored``
writes them, few to a file, so that a task holds few shards however many it reads. ``search``
takes the items in blocks of bounded size. For a block, the document frequencies of its
terms are summed over all shards; then each shard is searched by MaxScore: a term's list has
an upper bound (its greatest score in the shard), lists are sorted by it, and those whose
bounds together stay below the score of the k-th document found so far are non-essential.
Candidates come from the essential lists alone; the others are probed, greatest bound
first, for the candidates that can still qualify. A task carries its k best of each item
from shard to shard; the tasks' best are merged at the end.

Defined results: a null text has no terms, and neither has an item with a null text a
result; each row is a document, repeated rows too; equal rows of items are one item, rows
that share an id but not a text are items of their own; of equal scores the smaller doc_id
ranks first, null last; an empty table of either gives an empty result; columns beyond id
and text are not looked at.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table
from .terms import LETTERS_AND_DIGITS, arrow_texts, term_lists

TOP, SLOPE = 50, 50
#: Postings and documents in a shard; characters of items in a block.
SHARD_POSTINGS, SHARD_DOCS, BLOCK_CHARS = 500_000, 100_000, 1_000_000
#: Shards in a file.
FILE_SHARDS = 4
SHARD = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, places array<int>, counts array<int>"
BEST = "item int, doc_id long, score long"
LAST = np.int64(2**63 - 1)


def index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard. Its terms' postings stand one after the other: those of term i from starts[i] to starts[i + 1]."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shard()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), arrow_texts(batch.column(1)), strict=True):
                own.add(doc, body)
                if len(own.term) >= SHARD_POSTINGS or len(own.doc_ids) >= SHARD_DOCS:
                    yield own.row()
                    own = Shard()
        if own.doc_ids:
            yield own.row()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SHARD)


def stored(shards: DataFrame) -> DataFrame:
    """An index, written. Spark's reader holds the rows of a file together, so a file has few."""
    return scratch(shards, "shards", FILE_SHARDS)


class Shard:
    """Postings in the order of documents, until they are laid out by term. Documents without terms are left out."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.lengths, self.term, self.place, self.count = array("q"), array("i"), array("i"), array("i")
        self.code: dict[bytes, int] = {}

    def add(self, doc: int | None, body: bytes) -> None:
        counts: Counter[bytes] = Counter()
        for terms in term_lists(body, LETTERS_AND_DIGITS):
            counts.update(terms)
        if counts:
            code = self.code
            self.term.extend([code.setdefault(t, len(code)) for t in counts])
            self.count.extend(counts.values())
            self.place.extend([len(self.doc_ids)] * len(counts))
            self.doc_ids.append(doc)
            self.lengths.append(counts.total())

    def row(self) -> pa.RecordBatch:
        term, place, count = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (self.term, self.place, self.count))
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.code)))]).astype(np.int32)
        lists = [pa.array(self.doc_ids, pa.int64()), pa.array(np.array(self.lengths, np.int64)), pa.array(list(self.code), pa.binary()), pa.array(starts), pa.array(place[order]), pa.array(count[order])]
        whole = [pa.array([len(self.doc_ids)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())]
        return pa.RecordBatch.from_arrays(whole + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], [x.split()[0] for x in SHARD.split(", ")])


@dataclass
class Item:
    """An item's terms (numbers in its block), and the best documents so far: score downwards, then doc_id."""

    terms: np.ndarray
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def least(self, top: int) -> int:
        """The score that a document must reach to be among the best."""
        return int(self.scores[-1]) if len(self.scores) >= top else 1

    def offer(self, scores: np.ndarray, doc_ids: np.ndarray, top: int) -> None:
        scores, doc_ids = np.append(self.scores, scores), np.append(self.doc_ids, doc_ids)
        best = np.lexsort((doc_ids, -scores))[:top]
        self.scores, self.doc_ids = scores[best], doc_ids[best]


@dataclass
class Found:
    """What MaxScore did, for tests: rows of essential and of non-essential lists, and documents probed in the latter."""

    essential: int = 0
    others: int = 0
    probed: int = 0


def max_score(item: Item, lists: list[tuple[np.ndarray, np.ndarray, int]], doc_ids: np.ndarray, score: np.ndarray, top: int, found: Found | None = None) -> None:
    """Offers a shard's documents to an item. lists: places (ascending), their scores, and the greatest; score: zeros, one for each document, left as zeros."""
    lists = sorted(lists, key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists])
    least = item.least(top)
    n = int(np.searchsorted(reach, least))  # so many lists together stay below: a document must be in another one
    if n == len(lists):
        return
    for places, values, _ in lists[n:]:
        score[places] += values
    if n == len(lists) - 1:
        some = lists[n][0]
    else:
        some = np.unique(np.concatenate([x[0] for x in lists[n:]]))
    all_, some = some, some[score[some] + (reach[n - 1] if n else 0) >= least]
    if found:
        found.essential += sum(len(x[0]) for x in lists[n:])
        found.others += sum(len(x[0]) for x in lists[:n])
    for i in range(n - 1, -1, -1):
        places, values, _ = lists[i]
        if found:
            found.probed += len(some)
        at = np.minimum(np.searchsorted(places, some), len(places) - 1)
        there = places[at] == some
        score[some[there]] += values[at[there]]
        some = some[score[some] + (reach[i - 1] if i else 0) >= least]
    if len(some):
        item.offer(score[some], doc_ids[some], top)
    score[all_] = 0


@dataclass
class Block:
    """Items of a block, their terms, and what they are weighed by."""

    texts: list[str | None]
    numbers: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for text in self.texts:
            terms = {t for part in term_lists((text or "").encode(), LETTERS_AND_DIGITS) for t in part}
            self.items.append(np.array(sorted(self.numbers.setdefault(t, len(self.numbers)) for t in terms), np.int64))

    def places(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of a shard's terms those that are the block's: where they stand, and their numbers."""
        number = pc.index_in(terms, value_set=pa.array(list(self.numbers), pa.binary())).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~np.isnan(number.astype(np.float64)))
        return at, number[at].astype(np.int64)


def list_of(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return batch.column(name)[row].values


def frequencies(shards: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each of the block's terms is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(block.numbers), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at, number = block.places(list_of(batch, "terms", row))
                starts = list_of(batch, "starts", row).to_numpy()
                sums[number] += starts[at + 1] - starts[at]
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sums[there])], ["term", "df"])

    found = shards.select("terms", "starts").mapInArrow(work, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(block.numbers), np.int64)
    for row in found:
        out[row.term] = row.df
    return out


def best_of(shards: DataFrame, block: Block, df: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (number in the block), doc_id, score: the best of each task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(x) for x in block.items]
        for batch in batches:
            for row in range(batch.num_rows):
                search_shard(batch, row, block, items, weight, n_docs, n_terms, top)
        number = np.repeat(np.arange(len(items), dtype=np.int32), [len(x.scores) for x in items])
        if len(number):
            doc_ids, scores = np.concatenate([x.doc_ids for x in items]), np.concatenate([x.scores for x in items])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(doc_ids, mask=doc_ids == LAST), pa.array(scores)], ["item", "doc_id", "score"])

    return shards.mapInArrow(work, BEST)


def search_shard(batch: pa.RecordBatch, row: int, block: Block, items: list[Item], weight: np.ndarray, n_docs: int, n_terms: int, top: int, found: Found | None = None) -> None:
    at, number = block.places(list_of(batch, "terms", row))
    doc_ids = pc.fill_null(list_of(batch, "doc_ids", row), LAST.item()).to_numpy()
    lengths, starts, places, counts = (list_of(batch, n, row).to_numpy() for n in ("lengths", "starts", "places", "counts"))
    measure = 100 - SLOPE + SLOPE * lengths * n_docs // n_terms
    lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for i, term in zip(at.tolist(), number.tolist(), strict=True):
        own, tf = places[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]].astype(np.int64)
        values = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * measure[own]))
        lists[term] = own, values, int(values.max())
    score = np.zeros(len(doc_ids), np.int64)
    for item in items:
        own_lists = [lists[t] for t in item.terms.tolist() if t in lists]
        if own_lists:
            max_score(item, own_lists, doc_ids, score, top, found)


def search(shards: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score. shards: an index, written; items of any number, block by block."""
    spark = shards.sparkSession
    wanted = scratch(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct(), "items")
    whole = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_blocks = max(1, math.ceil((wanted.agg(F.sum(F.length("text") + 50)).first()[0] or 0) / BLOCK_CHARS))
    keyed = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    kind = items.schema[item_id].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(n_blocks if whole.docs else 0):
        rows = keyed.filter(F.col("block") == number).collect()
        block = Block([r.text for r in rows])
        if block.numbers:
            found = best_of(shards, block, frequencies(shards, block), whole.docs, whole.terms, top)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
            ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top)
            out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = stored(index(table(spark, sf_dir, "documents")))
    return search(shards, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
terms AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT d, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT d, sum(tf)::BIGINT AS n FROM counts GROUP BY d),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM lengths),
measures AS (SELECT d, 100 - 50 + (50 * n * big_n) // l AS m FROM lengths, whole),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole),
items AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, i.text, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM items i JOIN counts USING (term) JOIN weights USING (term) JOIN measures USING (d) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
