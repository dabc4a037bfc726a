"""Substring dedup by hashing the sentences of lines.

A line is cut behind each full stop, question or exclamation mark that white space follows,
so that a passage quoted in the middle of a line has units of its own; with ``paragraph``
the units are paragraphs. Units are normalised (ASCII letters lower-cased, white space
folded) and their digests grouped over all documents; the occurrence that ranks first, by
document id and then place, is kept. Later ones are repeats. Repeats that follow each other
are one run, and runs of at least ``RUN_WORDS`` words are removed, with their offsets in the
original text; shorter ones (a licence line, a two-word sentence that came about by chance)
are counted but stay.

Defined results: null and empty texts have no units; equal rows are one document, whose
equal units in equal places stay together; rows that share an id but not a text rank by a
hash of the text; null ids rank last; an empty table gives an empty result; columns beyond
id and text are not looked at, and ``cut`` replaces a column named ``cuts``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut_out, scratch, table, without

RUN_WORDS = 25
#: Tiles of a text, with the white space behind them; each character is in one tile.
TILES = {"sentence": r"[^\n]*?[.!?][\x20\t\r\x0b\x0c]+|[^\n]*\n|[^\n]+", "line": r"[^\n]*\n|[^\n]+", "paragraph": r"(?s:.+?(?:\n\n+|\Z))"}
UNITS = "doc_id long, body long, unit int, start int, stop int, n_words int, digest binary"


def units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence") -> DataFrame:
    """All units with a word, numbered in their text; offsets in code points, end exclusive; body: a hash of the text. A text is cut in one pass."""
    tile, lower, word = re.compile(TILES[unit]), str.maketrans(UPPER, LOWER), re.compile(r"[^\x20\x09-\x0D]+")
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
    names = [x.split()[0] for x in UNITS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc, own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body, number = value.as_py() or "", 0
                for m in tile.finditer(body):
                    tokens = word.findall(m[0])
                    if tokens:
                        digest = hashlib.md5(" ".join(tokens).translate(lower).encode(), usedforsecurity=False).digest()
                        for column, x in zip(columns, (doc, own, number, m.start(), m.end(), len(tokens), digest), strict=True):
                            column.append(x)
                        number += 1
                if len(columns[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                    columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("body"), F.col(text).alias("text")).mapInArrow(work, UNITS)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated(found: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """The units that repeat an earlier one, with it (first_doc_id, first_unit) and the words of their run; removed: run_words or more.

    Groups are reduced to their first occurrence and count before the shuffle, and written,
    so that a unit that a third of all documents have is a skewed join, which Spark splits.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("body").alias("body"), F.col("unit").alias("unit"))
    groups = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = scratch(groups.select("digest", "first"), "groups")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc")) & (F.col("body") == F.col("first.body")) & (F.col("unit") == F.col("first.unit")))
    joined = found.join(groups, "digest").filter(later).dropDuplicates(["doc_id", "body", "unit"])
    own = Window.partitionBy("doc_id", "body")
    island = F.col("unit") - F.row_number().over(own.orderBy("unit"))
    run = F.sum("n_words").over(Window.partitionBy("doc_id", "body", "island"))
    placed = joined.withColumn("island", island).withColumn("run_words", run)
    return placed.select("doc_id", "body", "unit", "start", "stop", "n_words", "run_words", (F.col("run_words") >= run_words).alias("removed"), F.col("first.doc").alias("first_doc_id"), F.col("first.unit").alias("first_unit"))


def cut(docs: DataFrame, repeats: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed units taken out of the text, and ``cuts``: the units' bounds in the original text, none: an empty array."""
    bounds = repeats.filter("removed").groupBy(F.col("doc_id").alias("id"), "body").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    # the input's columns stay inside one struct while they are joined: no name of theirs can clash
    held = without(docs, ["cuts"])
    rows = held.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("own"), text_hash(F.col(text)).alias("same"))
    joined = rows.join(bounds, F.col("own").eqNullSafe(F.col("id")) & (F.col("same") == F.col("body")), "left")
    body = F.col(f"row.`{text}`")
    after = F.when(F.size("cuts") > 0, cut_out(body, F.col("cuts"))).otherwise(body)
    return joined.select(*[(after if c == text else F.col(f"row.`{c}`")).alias(c) for c in held.columns], F.coalesce("cuts", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("cuts"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: its units, those that repeat an earlier one, and what is removed, with offsets."""
    docs = table(spark, sf_dir, "documents")
    return counted(docs, scratch(units(docs), "units"))


def counted(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_units, n_repeated, n_removed, removed_words, removed (start:stop, comma-joined). found: the docs' units, written."""
    spot = F.when(F.col("removed"), F.struct("start", "stop"))
    per = repeated(found, run_words).groupBy("doc_id", "body").agg(
        F.count(F.lit(1)).alias("n_repeated"), F.count_if("removed").alias("n_removed"), F.sum(F.when(F.col("removed"), F.col("n_words")).otherwise(0)).alias("removed_words"), F.array_sort(F.collect_list(spot)).alias("cuts")
    )
    offsets = F.array_join(F.transform("cuts", lambda c: F.concat_ws(":", c["start"].cast("string"), c["stop"].cast("string"))), ",")
    # units are numbered from 0 in their text; rows that are equal have the same ones
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("body"))
    for more in (found.groupBy("doc_id", "body").agg((F.max("unit") + 1).alias("n_units")), per):
        own = more.withColumnsRenamed({"doc_id": "_doc", "body": "_body"})
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body")), "left").drop("_doc", "_body")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", *[zero(c) for c in ("n_units", "n_repeated", "n_removed", "removed_words")], F.coalesce(offsets, F.lit("")).alias("removed"))


SQL = r"""
WITH tiles AS (
  SELECT doc_id, i, tile, CAST(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS stop
  FROM (SELECT doc_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS tile
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*?[.!?][\x20\t\r\x0b\x0c]+|[^\n]*\n|[^\n]+') AS ts FROM documents WHERE text IS NOT NULL))),
worded AS (
  SELECT doc_id, i, stop - length(tile) AS start, stop, regexp_extract_all(tile, '[^\x20\x09-\x0D]+') AS tokens FROM tiles),
units AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS unit, start, stop, len(tokens) AS n_words,
    md5(translate(array_to_string(tokens, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest
  FROM worded WHERE len(tokens) > 0),
later AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island
  FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, unit) AS place FROM units) WHERE place > 1),
runs AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, island) >= 25 AS removed FROM later),
per AS (
  SELECT doc_id, count(*) AS n_repeated, count(*) FILTER (removed) AS n_removed, coalesce(sum(n_words) FILTER (removed), 0) AS removed_words,
    coalesce(string_agg(CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start) FILTER (removed), '') AS removed
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(u.n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id) u USING (doc_id) LEFT JOIN per USING (doc_id)
"""
