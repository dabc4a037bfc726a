"""Helpers that the operators share: scratch tables, spans of regular expressions, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.sources.scratch import shared_folder
from groma.sources.scratch import written as scratch

__all__ = ["scratch"]
#: The white space that separates words: space and tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separates matches from the text between them; replaced in the text beforehand.
MARK, STAND_IN = "\x01", "\x02"
#: Elements in a chunk of a prefix fold.
CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/groma-{name}-{uuid.uuid4().hex}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body's lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.filter(F.split(empty_if_null(text), GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Prefix folds of an array of int, each element's own included: sums or maxima from the start.

    An array that grows by one element at a time is copied each time, so the folds run over
    chunks of ``CHUNK`` elements, and once more over the chunks.
    """

    def fold(part: Column, value: Callable[[Column], Column]) -> Column:
        nothing = F.named_struct(F.lit("last"), F.lit(zero), F.lit("all"), F.expr("cast(array() as array<int>)"))
        add = lambda state, x: let(op(state["last"], value(x)), lambda y: F.struct(y.alias("last"), F.concat(state["all"], F.array(y)).alias("all")))
        return F.aggregate(part, nothing, add, lambda state: state["all"])

    def joined(parts: Column) -> Column:
        before = fold(parts, lambda part: F.element_at(part, -1))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda part, i: F.transform(part, lambda x: op(F.coalesce(F.get(b, i - 1), F.lit(zero)), x)))))

    def whole(own: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))
        chunks = F.transform(numbers, lambda c: fold(F.slice(own, c * CHUNK + 1, F.lit(CHUNK)), lambda x: x))
        return F.when(F.size(own) > 0, let(chunks, joined)).otherwise(F.expr("cast(array() as array<int>)"))

    return let(values, whole)


def split_at(text: Column, pattern: str) -> Column:
    """The text cut before and behind each leftmost match: parts with odd numbers (from 0) are the matches.

    The pattern must not match the two control characters MARK and STAND_IN.
    """
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK, -1)


def stops(parts: Column) -> Column:
    """Where each part ends, in code points."""
    return running(F.transform(parts, F.length), lambda a, b: a + b)


SPANS = "array<struct<start:int,end:int,kind:string,piece:string>>"


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost matches that do not overlap: array<struct<start,end,kind,piece>>, in code points, end exclusive. Time is linear in the text."""

    def found(parts: Column) -> Column:
        one = lambda ends: lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), F.get(parts, i).alias("piece"))
        return let(stops(parts), lambda ends: F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one(ends)))

    some = let(split_at(text, pattern), lambda parts: F.when(F.size(parts) > 1, found(parts)))
    return F.coalesce(F.when(text.rlike(pattern), some), F.from_json(F.lit("[]"), SPANS))


def hits(items: Column, base: Column) -> Column:
    """For each of some spans, sorted and without overlaps: whether it overlaps a base span.

    Of the base spans that start before the item ends, one must end behind its start. Both
    are merged in one sorted array, so time does not grow with the product of their numbers.
    """
    events = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("reach"), F.lit(0).alias("i"))),
        F.transform(items, lambda t, i: F.struct(t["end"].alias("at"), F.lit(0).alias("is_base"), F.lit(0).alias("reach"), i.alias("i"))),
    )

    def flags(es: Column) -> Column:
        reached = running(F.transform(es, lambda e: e["reach"]), F.greatest)
        own = let(reached, lambda r: F.transform(es, lambda e, k: F.struct(e["is_base"].alias("is_base"), F.get(r, k).alias("reach"), e["i"].alias("i"))))
        return F.transform(F.filter(own, lambda e: e["is_base"] == 0), lambda e: e["reach"] > F.get(items, e["i"])["start"])

    return F.when((F.size(base) > 0) & (F.size(items) > 0), let(F.array_sort(events), flags)).otherwise(F.transform(items, lambda t: F.lit(False)))


def cut_out(text: Column, cuts: Column, put: str = "") -> Column:
    """The text with each cut (struct of start and stop, sorted by start) replaced by ``put``; overlapping cuts count as one.

    Pieces are taken from a form with four bytes for each code point, where a place is found without reading what lies before it.
    """
    wide = lambda whole, a, b: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(whole, a * 4 + 1, (b - a) * 4)), "UTF-32")

    def pieces(whole: Column, reached: Column) -> Column:
        def before(c: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reached, i - 1), F.lit(0))
            return F.when(c["start"] >= at, F.concat(wide(whole, at, c["start"]), F.lit(put))).otherwise("")

        last = wide(whole, F.element_at(reached, -1), F.length(text))
        return F.concat(F.array_join(F.transform(cuts, before), ""), last)

    reached = running(F.transform(cuts, lambda c: c["stop"]), F.greatest)
    return let(F.encode(text, "UTF-32"), lambda whole: let(reached, lambda r: pieces(whole, r)))


def sorted_spans(parts: Sequence[Column], kinds: Sequence[str]) -> Column:
    """Spans of several kinds by start, then kind in the order listed, then end."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without columns of these names, in whatever case: an operator's own columns replace an input's."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
