"""Quality rules under weak supervision.

Each rule looks at a text's statistics and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the table of vote patterns (3^rules rows at most, however
many documents) estimates each rule's accuracy and the share of good documents; the posterior probability of good replaces the all-must-pass filter.

Defined results: a null or empty text has zero words and fails the base; repeated rows are
judged alike; ties at the threshold are kept; an empty table gives an empty result. Very
long texts stay within their row: repeats are found by sorting a text's window hashes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_if_null, let, scratch, table, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "#*$%&|<>"
ROUNDS, SETTLED = 20, 1e-3
KEEP_AT = 0.5


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""

    def covered(marked: Column) -> Column:
        # marked: the sorted starts of repeated windows; each covers WINDOW words, less what the next one covers too
        gaps = F.transform(marked, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(marked, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(hashed: Column) -> Column:
        keyed = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        alike = lambda s, x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        twins = let(keyed, lambda s: F.filter(s, lambda x, j: alike(s, x, j)))
        return let(F.array_sort(F.transform(twins, lambda x: x["at"])), covered)

    def of(array: Column) -> Column:
        count = F.size(array)
        hashed = F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(array, i, WINDOW)))
        some = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
        return F.when(count > WINDOW, some).otherwise(F.lit(0))

    return let(tokens, of).cast("long")


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and its counts; the texts themselves are not carried on."""
    body = empty_if_null(F.col(text))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # taking out runs costs one pass; counting matches one by one would make an array of them
    without_runs = lambda of: F.length(F.regexp_replace(body, f"{of}+", "")).cast("long")
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        of_words.alias("of_words"),
        of_lines.alias("of_lines"),
        F.length(body).cast("long").alias("n_chars"),
        without_runs(f"[{SYMBOLS}]").alias("no_symbols"),
        without_runs(r"\p{Lu}").alias("no_upper"),
        without_runs(r"[\p{L}\x20\x09-\x0D.,]").alias("n_odd"),
        count(r"[!?]{2}").alias("n_shouts"),
        count(r"[\x20\x09-\x0D]\|[\x20\x09-\x0D]").alias("n_bars"),
    ).select(
        "doc_id", "of_words.*", "of_lines.*", "n_odd", "n_shouts", "n_bars",
        (F.col("n_chars") - F.col("no_symbols")).alias("n_symbols"), (F.col("n_chars") - F.col("no_upper")).alias("n_upper"),
    )


def votes() -> dict[str, Column]:
    """The rules: -1 where a trait of junk is plain, 1 where the text reads as prose, 0 (abstains) otherwise or on too little text."""
    n = F.col("n_words")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    mean = ratio("word_chars", "n_words")
    bad_from = lambda value, least, enough: F.when(enough & (value >= least), -1).otherwise(0)
    return {
        "length": F.when(n < MIN_WORDS, -1).otherwise(0),
        "word_size": F.when(n < 5, 0).when((mean < 2.5) | (mean > 14), -1).otherwise(0),
        "plain": F.when(n < 5, 0).when(ratio("n_odd", "word_chars") <= 0.04, 1).when(ratio("n_odd", "word_chars") > 0.12, -1).otherwise(0),
        "symbols": bad_from(ratio("n_symbols", "n_words"), 0.15, n >= 5),
        "capitals": bad_from(ratio("n_upper", "word_chars"), 0.4, n >= 5),
        "shouts": bad_from(ratio("n_shouts", "n_words"), 0.1, n >= 5),
        "bars": bad_from(ratio("n_bars", "n_words"), 0.15, n >= 5),
        "repeats": bad_from(ratio("n_repeat_words", "n_words"), 0.3, n >= MIN_WORDS),
        "lines": bad_from(ratio("n_dup_lines", "n_lines"), 0.3, F.col("n_lines") >= 4),
        "variety": bad_from(1 - ratio("n_distinct", "n_words"), 0.9, n >= MIN_WORDS),
    }


def fit(patterns: DataFrame, names: Sequence[str], rounds: int = ROUNDS) -> dict:
    """EM over vote patterns (columns names, n). Each round is one aggregate over the table of patterns.

    A rule has one accuracy, the chance that a vote of it is right. Four right votes and one
    wrong vote added to each keep the estimates inside (0, 1), and a rule that never votes at 0.8.
    """
    model = {"prior": 0.8, "accuracy": dict.fromkeys(names, 0.8)}
    for _ in range(rounds):
        p = posterior(model)
        n = F.col("n")
        right = [F.sum(F.when(F.col(k) == 1, n * p).when(F.col(k) == -1, n * (1 - p)).otherwise(0.0)).alias(f"{k}_right") for k in names]
        cast = [F.sum(F.when(F.col(k) != 0, n).otherwise(0)).alias(f"{k}_votes") for k in names]
        got = patterns.agg(F.sum(n * p).alias("good"), F.sum(n).alias("all"), *right, *cast).first()
        if not got["all"]:
            break
        before, model = model, {"prior": (got["good"] + 4) / (got["all"] + 5), "accuracy": {k: (got[f"{k}_right"] + 4) / (got[f"{k}_votes"] + 5) for k in names}}
        if max(abs(before["accuracy"][k] - model["accuracy"][k]) for k in names) < SETTLED:
            break
    return model


def posterior(model: dict) -> Column:
    """Probability that a document is good, from its votes. The weights go in as one array, so that every round runs the same compiled code."""
    logit = lambda p: log(p / (1 - p))
    weights = F.from_json(F.lit(json.dumps([logit(model["prior"]), *map(logit, model["accuracy"].values())])), "array<double>")
    odds = F.get(weights, F.lit(0))
    for i, k in enumerate(model["accuracy"], 1):
        odds = odds + F.col(k) * F.get(weights, F.lit(i))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the statistics, the votes, p_good, base_failed and kept."""
    rules = votes()
    voted = scratch(statistics(docs, doc_id=doc_id, text=text).withColumns(rules), "votes")
    patterns = scratch(voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = fit(patterns, list(rules), rounds)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    scored = voted.withColumn("p_good", posterior(model)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*out)
