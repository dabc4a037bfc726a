"""Codes, searches, times and cells of reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_key(code: Column) -> Column:
    """Hierarchical codes order by their numbers: 2.1 before 12.2 before 12.10."""
    return F.transform(F.split(code, "[.]"), lambda x: x.cast("int"))


def matches_search(text: Column, query: str) -> Column:
    """Every word of the query occurs in the text, without regard to case or to the letters io and ie."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    found = F.lit(True)
    for word in query.lower().replace("ё", "е").split():
        found = found & F.contains(folded, F.lit(word))
    return found


def parsed_time(text: Column, zone: str = "UTC") -> Column:
    """ISO 8601, or day.month.year hour:minute in a zone; null if it is neither."""
    local = F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm"))
    return F.coalesce(F.to_utc_timestamp(local, zone), F.try_to_timestamp(text))


def safe_cell(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary"), 256)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun beside a number."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tens.between(11, 14), many).when(ones == 1, one).when(ones.between(2, 4), few).otherwise(many)


def duration_label(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds: the two largest units that are not empty."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    rest = (s % 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit(" h "), m, F.lit(" min"))).when(s >= 60, F.concat(m, F.lit(" min "), rest, F.lit(" s"))).otherwise(F.concat(rest, F.lit(" s")))


def safe_name(text: Column) -> Column:
    """A file name: other characters than letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def search_key(text: Column) -> Column:
    """White space folded, case folded."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def distinct_parts(*parts: Column) -> Column:
    """Parts of an address: empty and repeated ones left out, in order."""
    trimmed = F.array(*[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.array_join(F.array_distinct(F.array_compact(trimmed)), ", ")


#: Named characters of HTML that texts are likely to hold; fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Tags taken out, the common named characters put back, white space folded."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for name, character in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def camera_and_time(name: Column) -> Column:
    """camera and time of a file named camera_YYYYMMDD_HHMMSS or camera-YYYY-MM-DD-HH-MM-SS; null for other names."""
    first, second = r"^(.+)_(\d{8})_(\d{6})\.\w+$", r"^(.+?)-(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})\.\w+$"
    a = F.concat(F.regexp_extract(name, first, 2), F.regexp_extract(name, first, 3))
    b = F.concat(*[F.regexp_extract(name, second, i) for i in range(2, 8)])
    one = F.struct(F.regexp_extract(name, first, 1).alias("camera"), F.try_to_timestamp(a, F.lit("yyyyMMddHHmmss")).alias("time"))
    two = F.struct(F.regexp_extract(name, second, 1).alias("camera"), F.try_to_timestamp(b, F.lit("yyyyMMddHHmmss")).alias("time"))
    return F.when(name.rlike(first), one).when(name.rlike(second), two)


def scene_key(dataset: Column, number: Column, block: int) -> Column:
    """Neighbouring frames of a recording have one key: the data set and the block of the frame's number."""
    return F.concat_ws("/", dataset, F.floor(number / block).cast("string"))


def name_uuid(namespace: str, name: Column) -> Column:
    """The UUID of version 5 of a name within a namespace: the SHA-1 of both, with version and variant put in."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def seeded_order(seed: int | str, name: Column) -> Column:
    """A tie-break that is the same on every run: the SHA-1 of ``seed:name``."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), name.cast("string")).cast("binary"))


#: How an excess is told, and the older wordings that it replaces.
EXCESS_COUNTED, EXCESS_SEEN = "Сверх плана {} ед. техники", "Обнаружена техника сверх плана"
EXCESS_BEFORE, EXCESS_LONG = "Техника сверх плана", "Количество превышает план; параллельные работы не объясняют избыток"


def shown_message(message: Column, kind: Column, excess: Column) -> Column:
    """A finding's message as it is shown now; excess: how many things there are too many, null where no classes are listed."""
    before, after = EXCESS_COUNTED.split("{}")
    counted = F.concat(F.lit(before), excess.cast("string"), F.lit(after))
    of_excess = F.when(F.coalesce(excess, F.lit(0)) != 0, counted).when(message.rlike(rf"^{before}\d+{after.replace('.', chr(92) + '.')}$"), message).otherwise(EXCESS_SEEN)
    is_excess = F.coalesce(kind == "excess", F.lit(False)) | (message == EXCESS_BEFORE)
    # only the first place is replaced
    at = F.locate(EXCESS_LONG, message)
    replaced = F.when(at > 0, F.concat(F.substring(message, F.lit(1), at - 1), F.lit(EXCESS_SEEN), F.substring(message, at + len(EXCESS_LONG), F.length(message)))).otherwise(message)
    return F.when(is_excess, of_excess).otherwise(replaced)


def default_step(sample_seconds: Column, steps: Column, least: int = 6) -> Column:
    """The first smoothing step of at least so many samples, the longest one where none is. An interval that is missing, not above zero or not finite counts as a second."""
    finite = (sample_seconds > 0) & (sample_seconds < float("inf"))
    interval = F.when(F.coalesce(finite, F.lit(False)), sample_seconds).otherwise(1)
    return F.coalesce(F.array_min(F.filter(steps, lambda s: s >= least * interval)), F.array_max(steps))


def period_fault(start: Column, end: Column) -> Column:
    """What is wrong with a period given as ISO texts, of which either may be null: no time (``time``), no zone (``zone``), an end that is not after the start (``order``); null if nothing is."""
    zoned = lambda t: t.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$")
    at = F.try_to_timestamp
    unread = (start.isNotNull() & at(start).isNull()) | (end.isNotNull() & at(end).isNull())
    unzoned = (start.isNotNull() & ~zoned(start)) | (end.isNotNull() & ~zoned(end))
    return F.when(unread, "time").when(unzoned, "zone").when(at(start) >= at(end), "order")
