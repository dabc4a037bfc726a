"""Plans from CSV, label files of boxes, and reports as CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groma.functions.text import parsed_time, safe_cell

MOST_BYTES, CYRILLIC = 5 << 20, "windows-1251"


def plan_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and separator of a plan file: UTF-8 if it can be read so, else Windows-1251; the separator that its header has more of.

    A plan is small (``MOST_BYTES``), and a larger file is refused before it is read.
    """
    listed = spark.read.format("binaryFile").load(path)
    size = listed.agg(F.max("length")).first()[0]
    if size is None or size > MOST_BYTES:
        raise ValueError(f"a plan file of at most {MOST_BYTES} bytes is needed")
    content = bytes(listed.select("content").first()[0])
    try:
        text, encoding = content.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError:
        text, encoding = content.decode("cp1251"), CYRILLIC
    header = text.split("\n", 1)[0]
    return encoding, ";" if header.count(";") >= header.count(",") else ","


def plan_rows(spark: SparkSession, path: str, *, headers: Mapping[str, Sequence[str]], classes: Mapping[str, str], zone: str = "UTC", sep: str | None = None) -> DataFrame:
    """row (its number in the file, the header being 1), code, title, starts_at, ends_at, resources, errors.

    headers: names by which each field may go; classes: class id by column name. A row with
    faults is returned with what is wrong in it, not dropped; a blank count is 0.
    """
    encoding, found_sep = plan_format(spark, path)
    # quoted cells may hold line breaks, so the file is one task and its rows keep their order
    plain = encoding != CYRILLIC
    raw = spark.read.csv(path, sep=sep or found_sep, header=True, encoding=encoding if plain else "ISO-8859-1", multiLine=True)
    if not plain:
        # Spark reads no Windows-1251: its bytes are read one by one, as Latin 1, and then given their letters
        high = bytes(range(0x80, 0x100))
        latin, letters = high.decode("latin-1"), high.decode("cp1251", "replace")
        raw = raw.select(*[F.translate(F.col(f"`{c}`"), latin, letters).alias(c.translate(str.maketrans(latin, letters))) for c in raw.columns])
    raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns]).withColumn("_row", F.monotonically_increasing_id() + 2)
    by_name = {c.lower(): c for c in raw.columns if c != "_row"}

    def field(name: str) -> Column:
        found = next((by_name[h.lower()] for h in headers[name] if h.lower() in by_name), None)
        return F.trim(F.col(f"`{found}`")) if found else F.lit(None).cast("string")

    present = {k: c for k, c in classes.items() if k in raw.columns}
    cell = lambda k: F.coalesce(F.nullif(F.trim(F.col(f"`{k}`")), F.lit("")), F.lit("0"))
    starts, ends = parsed_time(field("starts_at"), zone), parsed_time(field("ends_at"), zone)
    counts = [x for k, c in present.items() for x in (F.lit(c), cell(k).try_cast("int"))]
    faults = [
        F.when(~F.coalesce(field("code").rlike(r"^\d+(\.\d+)*$"), F.lit(False)), "code"),
        F.when(starts.isNull() | ends.isNull(), "time"),
        F.when(starts >= ends, "period"),
        *[F.when(~F.coalesce(cell(k).try_cast("int").between(0, 10_000), F.lit(False)), k) for k in present],
    ]
    resources = F.create_map(*counts) if counts else F.create_map().cast("map<string,int>")
    return raw.select(F.col("_row").alias("row"), field("code").alias("code"), field("title").alias("title"), starts.alias("starts_at"), ends.alias("ends_at"), resources.alias("resources"), F.array_compact(F.array(*faults)).alias("errors"))


def box_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines "class x y w h", or a class and a polygon's points, as centre boxes; path, line text, class_id, x, y, w, h, valid."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).filter("line <> ''")
    parts = F.split("line", r"\s+")
    numbers = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.try_cast("double"))
    rows = lines.select("path", "line", F.get(parts, F.lit(0)).try_cast("int").alias("class_id"), numbers.alias("v"))
    xs, ys = F.filter("v", lambda _, i: i % 2 == 0), F.filter("v", lambda _, i: i % 2 == 1)
    is_box, is_polygon = F.size("v") == 4, (F.size("v") >= 6) & (F.size("v") % 2 == 0)
    mid = lambda a: (F.array_max(a) + F.array_min(a)) / 2
    wide = lambda a: F.array_max(a) - F.array_min(a)
    pick = lambda i, polygon: F.when(is_box, F.get("v", F.lit(i))).when(is_polygon, polygon)
    made = rows.select("path", "line", "class_id", "v", pick(0, mid(xs)).alias("x"), pick(1, mid(ys)).alias("y"), pick(2, wide(xs)).alias("w"), pick(3, wide(ys)).alias("h"))
    whole = F.forall("v", lambda x: x.isNotNull() & x.between(0, 1)) & F.col("class_id").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0)
    return made.withColumn("valid", F.coalesce(whole, F.lit(False))).drop("v")


def label_line(kind: Column, *numbers: Column) -> Column:
    return F.concat_ws(" ", kind.cast("string"), *[F.format_string("%.6f", n) for n in numbers])


def write_report(df: DataFrame, path: str) -> None:
    """CSV with semicolons; text cells cannot become formulas."""
    cells = [safe_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cells).write.csv(path, sep=";", header=True)


def portable_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and two checksums that other engines can compute alike; the order of rows does not change them.

    Columns are taken as texts with their lengths before them, so no two rows read the same,
    and null is a mark of its own. The checksums are sums of both ends of the rows' MD5, sixty
    bits each, so neither equal rows nor pairs of them cancel.
    """
    cell = lambda c: F.when(F.col(f"`{c}`").isNull(), "-").otherwise(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")))
    spelled = [cell(c) for c in columns]
    md5 = F.md5(F.concat_ws("|", *spelled).cast("binary"))
    part = lambda start: F.conv(F.substring(md5, start, 15), 16, 10).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total(part(1)).alias("checksum"), total(part(18)).alias("checksum_end"))


def digest(df: DataFrame) -> DataFrame:
    """Row count and checksums of the content that the order of rows does not change: sums of two hashes of each row, which no pair of equal rows cancels."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total(F.xxhash64(row)).alias("checksum"), total(F.xxhash64(F.lit(1), row)).alias("total"))
