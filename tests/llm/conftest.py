"""A table of awkward documents: nulls, empty and long texts, repeats, ties, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

#: Names that operators or stages use for columns of their own.
CLASHING = ["row", "id", "own", "whole", "label", "base", "found", "cuts", "copies", "rate", "taken", "target", "source_size", "copy", "_id", "_row", "_kept", "_source", "_copy", "_base", "_more", "digest", "body", "unit", "cls", "hub", "token", "ids", "n"]


@pytest.fixture(scope="session")
def awkward(spark):
    prose = "the quick brown fox jumps over the lazy dog while seven tall ships sail slowly past the old harbour wall at dawn today"
    texts = [prose, prose, f"{prose} again", None, "", " \n ", "one two three", "x" * 60_000, "lorem ipsum " * 9000, f"{prose}\n{prose}\npassword = hunter2hunter2 mail a.b@example.org"]
    rows = [(i, t, "en", None if i == 3 else f"s{i % 2}", len(t) if t else 0, "a", 1, None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, prose, None, None, None, "b", 2, None), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string, size int, score string")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")
