"""The divergence audit and ranked search against SQL and brute force, on tables and on awkward rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

divergence = pytest.importorskip("groma.llm.divergence")
lexical = pytest.importorskip("groma.llm.lexical")
SMALL = "/root/testdata/sf0.001"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return sorted(map(str, con.execute(sql).fetchall()))


def by_spark(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


AUDIT = ("lang", "source", "part", "item", "value", "rank")
RANKED = ("item_id", "rank", "doc_id", "score")


def test_audit_equals_sql_on_a_table(spark):
    got = by_spark(divergence.query(spark, SMALL), *AUDIT)
    assert got and got == by_sql(divergence.SQL, documents=f"{SMALL}/documents.parquet")


def test_audit_of_awkward_rows(spark, awkward, nothing, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_spark(divergence.query(spark, str(tmp_path)), *AUDIT)
    assert got and got == by_sql(divergence.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert divergence.audit(nothing).count() == 0


def skewed(rng, n):
    """Documents of which most are of one source and hold one term; some sources have none of the kept terms."""
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else f"s{rng.randrange(40)}"
        words = ["the"] * rng.randrange(4) + [f"w{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[rng.randrange(10)]}" for _ in range(rng.randrange(12))]
        rows.append((i, " ".join(words), rng.choice(["x", "y", None]), source))
    rows += [(n, "1 2 3", "x", "digits"), (n + 1, None, "x", "empty"), (n + 2, "alone in its tongue", "z", "only")]
    return rows


def test_audit_in_small_pieces(spark, tmp_path, monkeypatch):
    """Partial runs, runs that go on in the next batch, and blocks of pairs do not change the result."""
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    docs = spark.createDataFrame(skewed(random.Random(2), 600), "doc_id long, text string, lang string, source string").repartition(7)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = by_spark(divergence.query(spark, str(tmp_path)), *AUDIT)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == by_sql(divergence.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet")


def test_shares_are_exact_beyond_64_bits():
    count, total = np.array([10**13, 0, 7]), np.array([3 * 10**15] * 3)
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (c + 1) // (3 * 10**15) for c in count.tolist()]


def test_search_equals_sql_on_a_table(spark):
    got = by_spark(lexical.query(spark, SMALL), *RANKED)
    assert got and got == by_sql(lexical.SQL, documents=f"{SMALL}/documents.parquet", benchmark=f"{SMALL}/benchmark.parquet")


def test_search_of_awkward_rows_and_items(spark, awkward, nothing, tmp_path, monkeypatch):
    """Shards of a few postings and blocks of a few items; items null, empty, repeated, and of one id."""
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 15)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 200)
    rows = [(1, "The quick fox"), (1, "The quick fox"), (1, "harbour of lorem 99"), (2, None), (3, ""), (None, "dawn ipsum xyz"), (4, "nowhere found")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = by_spark(lexical.query(spark, str(tmp_path)), *RANKED)
    assert got and got == by_sql(lexical.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet", benchmark=f"{tmp_path}/benchmark.parquet/*.parquet")
    assert lexical.search(lexical.index(nothing), items).count() == 0
    assert lexical.search(lexical.index(awkward), items.filter("false")).count() == 0


def test_files_of_an_index_hold_few_shards(spark, tmp_path, monkeypatch):
    """Spark's reader holds a file's rows together: a task that wrote many shards leaves many files."""
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 40)
    whole, found = lexical.search, []
    monkeypatch.setattr(lexical, "search", lambda shards, items: found.append(shards) or whole(shards, items))
    docs = spark.createDataFrame([(i, f"fox w{i} w{i % 7} harbour") for i in range(400)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w3 w250"), (2, "fox")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = by_spark(lexical.query(spark, str(tmp_path)), *RANKED)
    assert got and got == by_sql(lexical.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet", benchmark=f"{tmp_path}/benchmark.parquet/*.parquet")
    files = [r["count"] for r in found[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 4 * lexical.FILE_SHARDS and max(files) <= lexical.FILE_SHARDS


def test_max_score_leaves_most_postings_alone_and_loses_nothing(spark):
    """Frequent terms become non-essential, and only documents that can still qualify are probed in their lists."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(5, 60)))) for i in range(4000)]
    lists = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).toArrow().to_batches()
    terms = [Counter(t.split()) for _, t in docs]
    n_docs, n_terms = len(docs), sum(c.total() for c in terms)
    block = lexical.Block(["w0 w1 w2 w150", "w0 w3 w200 w250", "w5"])
    df = np.array([sum(t.decode() in c for c in terms) for t in block.numbers])
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    items, found = [lexical.Item(x) for x in block.items], lexical.Found()
    for batch in lists:
        for row in range(batch.num_rows):
            lexical.search_shard(batch, row, block, items, weight, n_docs, n_terms, 10, found)
            # the same shard again: what is among the best stays, so thresholds are known from the start
    first = lexical.Found()
    names = list(block.numbers)
    for item in items:
        want = []
        for i, c in enumerate(terms):
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            s = sum(int(weight[t]) * (10**9 * c[names[t].decode()] // (1000 * c[names[t].decode()] + 20 * m)) for t in item.terms.tolist() if c[names[t].decode()])
            if s > 0:
                want.append((-s, i))
        assert [(-s, d) for s, d in zip(item.scores.tolist(), item.doc_ids.tolist(), strict=True)] == sorted(want)[:10]
    again = [lexical.Item(i.terms, i.scores, i.doc_ids) for i in items[:1]]
    for batch in lists:
        for row in range(batch.num_rows):
            lexical.search_shard(batch, row, block, again, weight, n_docs, n_terms, 10, first)
    assert first.essential < first.others / 5 and first.probed < first.others / 5


def test_terms_are_cut_alike_in_parts(monkeypatch):
    from groma.llm import terms

    monkeypatch.setattr(terms, "PART", 5)
    text = "Ab1c é漢,x y ABC--def\n" * 9
    found = [t.decode() for part in terms.term_lists(text.encode(), terms.LETTERS) for t in part]
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert found == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
    found = [t.decode() for part in terms.term_lists(text.encode(), terms.LETTERS_AND_DIGITS) for t in part]
    assert found == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)
