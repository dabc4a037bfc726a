"""Tables with as many columns as the data have classes: the event report and the plan file.

A first pass finds the classes (a bounded list: a catalogue's), a second one gives each its
columns. Cells are guarded against being taken for formulas, and files begin with a byte
order mark, so that spreadsheets read them as UTF-8.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groma.functions.text import code_key, safe_cell

#: A catalogue has fewer classes than this; more are an error, not cut off.
MOST_CLASSES = 2000
MARK = "﻿"
#: The columns of the event report, and what stands behind a class's name.
EVENT_COLUMNS = (
    "Объект",
    "Начало периода отчёта, МСК",
    "Конец периода отчёта, МСК",
    "Индекс этапа",
    "Этап",
    "Начало этапа, МСК",
    "Конец этапа, МСК",
    "Начало события, МСК",
    "Конец события, МСК",
    "Последнее наблюдение события, МСК",
    "Уведомление, МСК",
    "Источник",
    "Событие",
)
EXPECTED, SEEN, UNNAMED = "план", "на кадре", "Класс"
#: The columns of a plan file.
PLAN_COLUMNS = ("Код", "Этап стройки", "Дата и время начала этапа", "Дата и время конца этапа")


def classes_of(df: DataFrame, maps: Sequence[Column], known: Sequence[str] = ()) -> list[str]:
    """The keys of all maps and the known classes: numbers by size, then other names."""
    nothing = F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(m), nothing) for m in maps]))
    found = [r[0] for r in df.select(F.explode(keys).alias("k")).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    numeric = lambda k: (0, int(k), k) if k.isdigit() else (1, 0, k)
    return sorted({*found, *known}, key=numeric)


def local_text(at: Column, zone: str) -> Column:
    """Day, month, year and time in a zone; empty for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "dd.MM.yyyy HH:mm:ss"), F.lit(""))


def local_iso(at: Column, zone: str) -> Column:
    """ISO 8601 in a zone, with its offset at that time."""
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(at)) / 60_000_000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def event_rows(alerts: DataFrame, *, works: DataFrame, sources: DataFrame, project: str, begins: Column, ends: Column, zone: str, names: Mapping[str, str], columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """The event report: confirmed events by their beginning, thirteen columns and two for each class, all texts.

    alerts: id, source_id, work_id, plan_id, status, first_seen, last_seen, message, code,
    title, work_starts_at, work_ends_at, notified_at, expected and counts (maps from class to
    number, values may be null), suppressed, confirmed. What an alert does not say of its work
    comes from works (plan_id, work_id, code, title, starts_at, ends_at), the version that it
    was made on. sources: source_id, name.
    """
    shown = alerts.filter((F.col("status") != "unknown") & (F.coalesce("message", F.lit("")) != "") & ~F.coalesce("suppressed", F.lit(False)) & F.coalesce("confirmed", F.lit(True)))
    classes = classes_of(shown, [F.col("expected"), F.col("counts")])
    of_work = works.select("plan_id", "work_id", *[F.col(c).alias(f"_{c}") for c in ("code", "title", "starts_at", "ends_at")])
    joined = shown.join(of_work, ["plan_id", "work_id"], "left").join(sources.select("source_id", F.col("name").alias("_source")), "source_id", "left")
    own = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.coalesce(F.col(other), F.lit("")))
    at = lambda c: local_text(c, zone)
    cells = [
        F.lit(project),
        at(begins),
        at(ends),
        own("code", "_code"),
        own("title", "_title"),
        at(F.coalesce("work_starts_at", "_starts_at")),
        at(F.coalesce("work_ends_at", "_ends_at")),
        at(F.col("first_seen")),
        F.when(F.col("status") == "resolved", at(F.col("last_seen"))).otherwise(""),
        at(F.col("last_seen")),
        at(F.col("notified_at")),
        F.coalesce("_source", F.lit("")),
        F.col("message"),
    ]
    number = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)).cast("string"), F.lit(""))
    headed = list(zip(columns, cells, strict=True))
    for k in classes:
        name = names.get(k, f"{UNNAMED} {k}")
        headed += [(f"{name}: {EXPECTED}", number("expected", k)), (f"{name}: {SEEN}", number("counts", k))]
    return joined.orderBy("first_seen", "id").select(*[safe_cell(c).alias(h) for h, c in headed])


def plan_table(works: DataFrame, *, current: Sequence[str], names: Mapping[str, str], zone: str, columns: Sequence[str] = PLAN_COLUMNS) -> DataFrame:
    """A plan's works by code, with a column for each class of now or of any of its works: an archived plan can be imported after classes were added.

    works: code, title, starts_at, ends_at, resources (map from class to number).
    """
    classes = classes_of(works, [F.col("resources")], current)
    counts = [F.coalesce(F.try_element_at(F.col("resources"), F.lit(k)), F.lit(0)).alias(names.get(k, f"{UNNAMED} {k}")) for k in classes]
    code, title, starts, ends = columns
    times = [local_iso(F.col(c), zone).alias(h) for c, h in (("starts_at", starts), ("ends_at", ends))]
    return works.orderBy(code_key(F.col("code")), "code").select(F.col("code").alias(code), F.col("title").alias(title), *times, *counts)


def plan_template(df: DataFrame, *, current: Sequence[str], names: Mapping[str, str], columns: Sequence[str] = PLAN_COLUMNS) -> DataFrame:
    """The header of a plan file alone: no rows."""
    heads = [*columns, *[names.get(k, f"{UNNAMED} {k}") for k in current]]
    return df.sparkSession.createDataFrame([], ", ".join(f"`{h}` string" for h in heads))


def write_table(rows: DataFrame, path: str) -> None:
    """Semicolons, a header behind a byte order mark. A report is one project's events, so it is one file, in order."""
    first = rows.columns[0]
    marked = rows.withColumnRenamed(first, MARK + first)
    marked.coalesce(1).write.csv(path, sep=";", header=True, quoteAll=False, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
