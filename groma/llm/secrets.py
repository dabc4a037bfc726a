"""Secret scans.

Three base patterns find assignments, access keys and hexadecimal runs. Beyond them, two
first-order Markov models of characters, of random strings and of ordinary identifiers, are
trained from labelled samples; a long token whose log-likelihood ratio speaks for the random
model becomes a span of its own (kind ``random``).

Defined results: a null text is an empty one, without spans; matches that fail a base
condition are dropped and not retried; repeated rows are scanned alike; an empty table gives
an empty result; other input columns are carried along, but for ``base`` and ``found``,
which the result replaces. The control
character U+0001 counts as U+0002, which no pattern matches either.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_out, empty_if_null, hits, let, listed, sorted_spans, spans, table, without

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run of these characters holds no longer one, so nothing is skipped by asking for the length here
HEX = r"[0-9a-f]{24,}"
#: Tokens that the models look at. Runs are taken whole: none begins or ends inside another.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Characters outside the alphabet count as its last one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
#: Log-likelihood ratio, in nats: at least this much in all, and per pair of neighbours.
LEAST_TOTAL, LEAST_MEAN = 15.0, 1.0
#: Random strings made for the labelled sample.
RANDOM_ROWS = 6000


def labelled_samples(docs: DataFrame, *, text: str = "text", random_rows: int = RANDOM_ROWS) -> DataFrame:
    """token, label (1: random string, 0: ordinary identifier). Random strings come from hashes of numbers, in
    hexadecimal, base 64 and upper-case forms; identifiers are the distinct words of all documents, with words of names joined as in code.
    Neither the order of rows nor copies matter. Long tokens, which may be keys themselves, are left out of the words."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    form = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, base64).otherwise(F.upper(F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", ""), 1, 32)))
    made = docs.sparkSession.range(random_rows).select(form.alias("token"), F.lit(1).alias("label"))
    shorter = docs.select(F.regexp_replace(text, TOKEN, " ").alias("text"))
    word = shorter.select(F.explode(F.array_distinct(F.split("text", r"[^A-Za-z]+"))).alias("word")).filter(F.length("word") >= 4).distinct()
    shapes = F.array(F.col("word"), F.lower("word"), F.upper("word"), F.concat(F.lower("word"), F.lit("_"), F.lower("word")), F.concat(F.upper("word"), F.lit("_"), F.upper("word")), F.concat(F.initcap(F.lower("word")), F.initcap(F.lower("word"))), F.concat(F.lit("/"), F.lower("word"), F.lit("-"), F.lower("word")))
    names = word.select(F.explode(shapes).alias("token"), F.lit(0).alias("label"))
    known = docs.sparkSession.range(1000).select(F.concat(F.lit("page_"), F.col("id").cast("string"), F.lit("-item"), (F.col("id") % 97).cast("string")).alias("token"), F.lit(0).alias("label"))
    return made.unionByName(names).unionByName(known)


def code(character: Column) -> Column:
    """Number of a character in the alphabet, from 0."""
    at = F.position(character, F.lit(ALPHABET))
    return F.when(at > 0, at - 1).otherwise(F.lit(SIZE - 1))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each pair of neighbours, at SIZE * first + second. Counts are summed by Spark; only SIZE^2 of them come back."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.col("token").substr(i, F.lit(2)))
    counted = samples.filter(F.length("token") >= 2).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    of = {0: [[smoothing] * SIZE for _ in range(SIZE)], 1: [[smoothing] * SIZE for _ in range(SIZE)]}
    for row in counted.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        of[row["label"]][ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["count"]
    ratio = lambda a, b: log(of[1][a][b] / sum(of[1][a])) - log(of[0][a][b] / sum(of[0][a]))
    return [ratio(a, b) for a in range(SIZE) for b in range(SIZE)]


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """Sum over the token's distinct pairs of neighbours of log P(random) - log P(ordinary). A pair said again, as in a rule of dashes, is no new evidence."""
    table_of_pairs = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), code)

    def total(numbers: Column) -> Column:
        pairs = F.array_distinct(F.transform(numbers, lambda c, i: F.get(numbers, i - 1) * SIZE + c))
        terms = F.transform(pairs, lambda x: F.coalesce(F.get(table_of_pairs, x), F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    return let(codes, total)


def base_spans(text: Column) -> Column:
    named = F.filter(spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["piece"], ASSIGN, 2)) >= 6)
    return F.concat(named, spans(text, ACCESS, "access"), spans(text, HEX, "hex"))


def random_spans(text: Column, base: Column, model: list[float]) -> Column:
    """Tokens for which the random model is the likelier, unless a base span has them already. Tokens without a letter (rules, dates, numbers) are not asked about."""
    lettered = F.filter(spans(text, TOKEN, "random"), lambda s: s["piece"].rlike("[A-Za-z]"))

    def likely(s: Column) -> Column:
        return let(likelihood_ratio(s["piece"], model), lambda x: (x >= LEAST_TOTAL) & (x >= LEAST_MEAN * F.length(s["piece"])))

    return let(lettered, lambda tokens: let(hits(tokens, base), lambda taken: F.filter(tokens, lambda s, i: ~F.get(taken, i) & likely(s))))


def scan(docs: DataFrame, model: list[float], *, text: str = "text") -> DataFrame:
    """docs with base (array of base spans) and found (all spans with start, end, kind), each sorted; columns of these names are replaced."""
    held = without(docs, ["base", "found"])
    body = empty_if_null(F.col(f"row.`{text}`"))
    based = held.select(F.struct("*").alias("row")).withColumn("own", base_spans(body))
    both = based.withColumn("more", let(F.col("own"), lambda b: random_spans(body, b, model)))
    base, every = sorted_spans([F.col("own")], KINDS), sorted_spans([F.col("own"), F.col("more")], KINDS)
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in held.columns], base.alias("base"), every.alias("found"))


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mask; overlapping spans by one."""
    cuts = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("stop")))
    return F.when(F.size(found) > 0, let(cuts, lambda c: cut_out(text, c, mask))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan(docs, train(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
