"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class gets a mean and a covariance, shrunk towards the pooled covariance and a multiple
of the identity. A document's score is the logistic of the difference of the two Gaussian
log densities, by Mahalanobis distances from Cholesky factors computed once.

Only statistics of the text go in. The fit uses at most ``TRAIN_ROWS`` labelled rows of each
class, those of smallest hash; all documents are scored. Defined results: a null or empty
text has zero statistics and is scored like any other; ids with several labels count with
the smaller one, null labels not at all; rows that share an id are one row of the sample;
repeated rows get the same score; with fewer than
two labelled rows of a class the score is 0.5 for all; an empty table gives an empty result;
input columns named like the result's (``COLUMNS``) are replaced by them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_if_null, let, table, words, without

COLUMNS = ["held_out", "score", "predicted"]
TRAIN_ROWS = 6000
SHRINK_TO_POOLED, SHRINK_TO_IDENTITY = 0.3, 0.1
#: The difference of log densities is divided by this before the logistic, as the statistics are not independent draws.
TEMPERATURE = 4.0


def features(text: Column) -> Column:
    """Transformed statistics of a text: logs of counts, logits of shares."""
    body = empty_if_null(text)
    size = F.length(body).cast("double")
    of = lambda pattern: size - F.length(F.regexp_replace(body, f"{pattern}+", ""))
    raw = F.struct(
        size.alias("size"),
        of(r"\p{Lu}").alias("upper"),
        of("[0-9]").alias("digit"),
        of(r"[\x20\x09-\x0D]").alias("space"),
        of(r"[#*$%&|<>!?@~^=_]").alias("symbol"),
        of(r"[.,;:]").alias("stop"),
        of("\n").alias("line"),
        words(text).alias("w"),
    )

    def derived(x: Column) -> Column:
        n = F.size(x["w"]).cast("double")
        chars = x["size"] - x["space"]
        share = lambda a, b, least=0.5: F.log((a + least) / (b - a + least + 1))
        distinct = F.size(F.array_distinct(x["w"])).cast("double")
        pairs = F.transform(F.sequence(F.lit(1), F.size(x["w"]) - 1), lambda i: F.xxhash64(F.slice(x["w"], i, 2)))
        fresh = F.when(n > 2, F.size(F.array_distinct(pairs)).cast("double")).otherwise(n)
        return F.array(
            F.log1p(n),
            F.log((chars + 5) / (n + 1)),
            share(x["upper"], chars),
            share(x["digit"], chars),
            share(x["symbol"], chars),
            share(x["stop"], n),
            share(n - distinct, n) - 0.3 * F.log1p(n),
            share(n - fresh, n, 1.0),
            F.log((x["line"] + 1) / (n + 10)),
        )

    return let(raw, derived)


@dataclass
class Gaussian:
    """A class: mean, inverse Cholesky factor of the shrunk covariance, its log determinant, log prior."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: float
    log_prior: float

    def log_density(self, x: Column) -> Column:
        """Of an array column of features: the factor is triangular, so each term has the features up to its own."""
        shift = self.whiten @ self.mean
        total = F.lit(self.log_prior - 0.5 * self.log_det)
        for i, row in enumerate(self.whiten):
            z = reduce(add, [F.get(x, F.lit(j)) * float(row[j]) for j in range(i + 1)]) - float(shift[i])
            total = total - z * z * 0.5
        return total


def fit(rows: pd.DataFrame, counts: dict[int, int]) -> tuple[Gaussian, Gaussian] | None:
    """Classes 0 and 1 from columns x (features) and label; the priors from the classes' counts among all labels."""
    by = {c: np.stack(rows.x[rows.label == c].to_numpy()) if (rows.label == c).sum() >= 2 else None for c in (0, 1)}
    if any(v is None for v in by.values()):
        return None
    centred = np.concatenate([v - v.mean(0) for v in by.values()])
    pooled = centred.T @ centred / len(centred)
    made = []
    for c in (0, 1):
        v = by[c]
        own = np.cov(v.T, bias=True)
        mixed = (1 - SHRINK_TO_POOLED) * own + SHRINK_TO_POOLED * pooled
        shrunk = (1 - SHRINK_TO_IDENTITY) * mixed + SHRINK_TO_IDENTITY * (np.trace(mixed) / len(mixed) + 1e-6) * np.eye(len(mixed))
        factor = np.linalg.cholesky(shrunk)
        made.append(Gaussian(v.mean(0), np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), float(np.log(counts[c] / sum(counts.values())))))
    return made[0], made[1]


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[Gaussian, Gaussian] | None:
    """usable: a condition on the column doc_id of labels. Only the rows of the sample are joined with their texts, and only statistics come back."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & usable).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("label"))
    sample = None
    for c in (0, 1):
        part = known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(doc_id).alias("own"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("own") == F.col("id"))  # at most 2 * rows rows of two numbers
    # rows that share an id count once, with the smallest of their statistics, so the bound holds for what reaches the driver
    drawn = joined.select("id", "label", features(F.col("text")).alias("x")).groupBy("id", "label").agg(F.min("x").alias("x"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return fit(drawn.orderBy("id").select("x", "label").toPandas(), counts)


def verdict(text: Column, model: tuple[Gaussian, Gaussian] | None) -> Column:
    """A text's score, from 0 to 1."""
    if model is None:
        return F.lit(0.5)
    odds = let(features(text), lambda x: (model[1].log_density(x) - model[0].log_density(x)) / TEMPERATURE)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def score(docs: DataFrame, model: tuple[Gaussian, Gaussian] | None, *, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    scored = without(docs, ["score", "predicted"]).withColumn("score", verdict(F.col(text), model))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
