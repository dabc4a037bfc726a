"""Personal data (PII).

Base patterns find e-mail and IP addresses, card and phone numbers. From these seeds the
bootstrap learns contexts. A candidate is a run of words with digits or @, single spaces
between them, so that a number written in groups is one. Its lexical patterns are the two
words before it, and the word before with the word after; its own form is no part of them,
so contexts reach identifiers of other forms than the seeds'. On the graph of patterns and
candidates, scores go back and forth: a pattern is trusted by the share of its instances
that are known, an instance by the trusted patterns that it occurs in. Instances that no
base pattern has, but trusted patterns do, become spans of their own (kind ``context``).

Defined results: a null text is an empty one, without spans; base matches that fail their
condition are dropped and not retried; repeated rows get the same spans; the start and the
end of a text, a candidate beside another one, count as words of their own in patterns; an
empty table gives an empty result, and input columns beyond id and text are not looked at.
The control character U+0001 counts as U+0002.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, SPANS, empty_if_null, hits, let, listed, scratch, sorted_spans, spans, split_at, stops, table

KINDS = ["email", "ip", "card", "phone", "context"]
#: Written so that matching takes linear time: a match begins where a run of its first characters begins, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
UP_TO_255 = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words with a digit or an at sign, and runs of them.
ITEM = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CANDIDATE = rf"{ITEM}(?:\x20{ITEM})*+"
#: An identifier that contexts can find has at least so many digits or an at sign.
LEAST_DIGITS = 5
#: Instances are told apart by their text, longer ones by its digest: a table or encoded data does not travel in every shuffle.
PLAIN_CHARS = 64
OCCURRENCES = "array<struct<start:int,end:int,piece:string,left:string,last:string,right:string>>"
ROUNDS = 3
#: A pattern is trusted from this share and this number of known instances on; an instance is new personal data from this score on.
TRUST, SUPPORT, ACCEPT = 0.6, 3, 0.6


def digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]+", "")


def passes_luhn(number: Column) -> Column:
    """number: a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.reverse(number).substr(i + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    ip = F.filter(spans(text, IP, "ip"), lambda s: s["piece"].rlike(rf"^{UP_TO_255}(?:\.{UP_TO_255}){{3}}$"))
    is_card = lambda s: let(digits(s["piece"]), lambda d: F.when(F.length(d).between(14, 19), passes_luhn(d)).otherwise(F.lit(False)))
    # runs of fewer than 14 digits and separators cannot pass: most texts are left alone
    cards = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), F.filter(spans(text, CARD, "card"), is_card)).otherwise(F.filter(spans(F.lit(""), CARD, "card"), lambda s: F.lit(True)))
    phones = F.filter(spans(text, PHONE, "phone"), lambda s: F.length(digits(s["piece"])).between(10, 15))
    return F.concat(spans(text, EMAIL, "email"), ip, cards, phones)


def occurrences(text: Column) -> Column:
    """Candidates with two words before and one after, lower-cased and without punctuation: array<struct<start,end,piece,left,last,right>>."""
    plain = lambda part: F.trim(F.regexp_replace(F.regexp_replace(F.lower(part), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), GAP, " "))
    or_mark = lambda word, mark: F.when(F.coalesce(word, F.lit("")) == "", mark).otherwise(word)

    def placed(parts: Column) -> Column:
        between = F.transform(parts, lambda x, i: F.when(i % 2 == 0, plain(x)).otherwise(""))

        def one(i: Column, ends: Column, texts: Column) -> Column:
            before, after = F.get(texts, i - 1), F.get(texts, i + 1)
            return F.struct(
                F.get(ends, i - 1).alias("start"),
                F.get(ends, i).alias("end"),
                F.get(parts, i).alias("piece"),
                F.substring_index(before, " ", -2).alias("left"),
                or_mark(F.substring_index(before, " ", -1), "^").alias("last"),
                or_mark(F.substring_index(after, " ", 1), "$").alias("right"),
            )

        numbers = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        return let(stops(parts), lambda ends: let(between, lambda texts: F.transform(numbers, lambda i: one(i, ends, texts))))

    some = let(split_at(text, CANDIDATE), lambda parts: F.when(F.size(parts) > 1, placed(parts)))
    return F.coalesce(F.when(text.rlike(ITEM), some), F.from_json(F.lit("[]"), OCCURRENCES))


def bootstrap(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pairs: pattern, instance, seed (distinct) -> instance, score of those that are no seeds and accepted.

    Each round joins the pairs with the instances' scores, averages them by pattern, and
    joins the trusted patterns back. Both sums have partial aggregation, so a pattern or
    instance with a third of all pairs is no hot spot.
    """
    scores = pairs.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        known = pairs.drop("seed").join(scores, "instance")
        patterns = known.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"), F.count_if(F.col("score") >= 0.5).alias("support"))
        trusted = patterns.filter((F.col("trust") >= TRUST) & (F.col("support") >= SUPPORT)).select("pattern", "trust")
        reached = pairs.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("found"))
        joined = scores.select("instance", "seed").join(reached, "instance", "left")
        scores = scratch(joined.select("instance", "seed", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score")), "scores")
    return scores.filter((F.col("seed") == 0) & (F.col("score") >= ACCEPT)).select("instance", "score")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (array of base spans) and found (all spans with start, end, kind), each sorted."""
    body = empty_if_null(F.col(text))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), body).alias("row"), sorted_spans([base_spans(body)], KINDS).alias("base"), occurrences(body).alias("items"))
    read = scratch(read, "personal")
    seeded = let(hits(F.col("items"), F.col("base")), lambda taken: F.transform("items", lambda o, i: F.struct(o.alias("o"), F.get(taken, i).cast("int").alias("seed"))))
    item = read.filter(F.size("items") > 0).select("row", F.explode(seeded).alias("x")).select("row", "x.o", "x.seed")
    item = item.withColumn("instance", F.lower(F.regexp_replace("o.piece", r"^[\p{Punct}&&[^+(]]+|[\p{Punct}]+$", "")))
    item = item.filter((F.length(digits(F.col("instance"))) >= LEAST_DIGITS) | F.col("instance").contains("@"))
    item = item.withColumn("instance", F.when(F.length("instance") <= PLAIN_CHARS, F.col("instance")).otherwise(F.sha2(F.col("instance").cast("binary"), 256)))
    two = F.when(F.col("o.left").contains(" "), F.concat_ws("|", F.lit("2"), "o.left"))
    around = F.when((F.col("o.last") != "^") | (F.col("o.right") != "$"), F.concat_ws("|", F.lit("1"), "o.last", "o.right"))
    pairs = item.select("instance", F.explode(F.array_compact(F.array(two, around))).alias("pattern"), "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    new = bootstrap(scratch(pairs, "pairs"))
    spot = F.struct(F.col("o.start").alias("start"), F.col("o.end").alias("end"), F.lit("context").alias("kind"), F.col("o.piece").alias("piece"))
    more = item.filter("seed = 0").join(new, "instance").groupBy("row").agg(F.collect_set(spot).alias("more"))
    nothing = F.from_json(F.lit("[]"), SPANS)
    joined = read.select("doc_id", "row", "base").join(more, "row", "left").withColumn("more", F.coalesce("more", nothing))
    both = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("").alias("piece"))), "more")
    return joined.select("doc_id", "base", sorted_spans([both], KINDS).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
