"""Data sets of pictures: COCO files, folders, and what is recorded about them."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = (
    "images array<struct<id:long,file_name:string,width:double,height:double>>, categories array<struct<id:long,name:string>>,"
    " annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,iscrowd:int>>"
)


def coco_boxes(spark: SparkSession, path: str) -> DataFrame:
    """file, image_id, name, class name and centre box of each annotation; valid is false where image, class or box is missing or nothing of the box lies in the picture.

    A file is one JSON document. Its three lists are joined by id, so a large file is spread after reading.
    """
    raw = spark.read.schema(COCO).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    images = raw.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("name"), "i.width", "i.height")
    kinds = raw.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("kind"))
    notes = raw.select("file", F.explode("annotations").alias("a")).select("file", F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox")
    joined = notes.join(images, ["file", "image_id"], "left").join(kinds, ["file", "category_id"], "left")
    at = lambda i: F.get("bbox", F.lit(i))
    x1, y1 = F.greatest(at(0), F.lit(0.0)), F.greatest(at(1), F.lit(0.0))
    x2, y2 = F.least(at(0) + at(2), F.col("width")), F.least(at(1) + at(3), F.col("height"))
    valid = F.coalesce((F.size("bbox") == 4) & F.col("kind").isNotNull() & F.col("width").isNotNull() & (x2 > x1) & (y2 > y1), F.lit(False))
    centre = [((x1 + x2) / 2 / F.col("width")).alias("x"), ((y1 + y2) / 2 / F.col("height")).alias("y"), ((x2 - x1) / F.col("width")).alias("w"), ((y2 - y1) / F.col("height")).alias("h")]
    return joined.select("file", "annotation_id", "image_id", "name", "kind", *centre, valid.alias("valid"))


def layout(files: DataFrame, *, path: str = "path") -> DataFrame:
    """path, split, kind and stem of a data set's files: train, valid (also val) and test folders, or one flat folder; staging folders are left out."""
    lower = F.lower(F.col(path))
    split = F.when(lower.rlike("/train/"), "train").when(lower.rlike("/val(id)?/"), "val").when(lower.rlike("/test/"), "test").otherwise("all")
    kind = F.when(lower.rlike(r"\.(jpe?g|png|bmp|webp)$"), "image").when(lower.rlike(r"\.txt$"), "label")
    rows = files.filter(~lower.rlike(r"/(\.|staging|tmp)[^/]*/"))
    return rows.select(path, split.alias("split"), kind.alias("kind"), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem")).filter("kind is not null")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def stem_without_version(stem: Column) -> Column:
    """The name that augmented copies of a picture share: what exporters append is taken off."""
    return F.regexp_replace(F.regexp_replace(stem, r"[._]rf[._][0-9a-f]{8,}$", ""), r"_(jpe?g|png)$", "")


ENTRIES = "path string, entry int, name string, size long, crc long, error string"


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """The files in ZIP archives, in the order of their names, which is also the order of their frames: path, entry (from 0), name, size, crc.

    Archives are opened where they lie (any file system that Arrow knows) and read from their
    end: only the directory is fetched, whatever an archive's size. One that cannot be read is
    a row with an error and nothing else.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                held, error = directory(at)
                rows = [(at, i, x.filename, x.file_size, x.CRC, None) for i, x in enumerate(held)] if error is None else [(at, None, None, None, None, error)]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = [x.split()[0] for x in ENTRIES.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, kinds, strict=True))))

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return archives.select("path").mapInArrow(listed, ENTRIES)


def directory(path: str) -> tuple[list[zipfile.ZipInfo], str | None]:
    """An archive's files by name, or what is wrong with it."""
    try:
        files, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
        with files.open_input_file(name) as opened, zipfile.ZipFile(opened) as archive:
            return sorted((x for x in archive.infolist() if not x.is_dir()), key=lambda x: x.filename), None
    except (zipfile.BadZipFile, OSError, NotImplementedError, pa.ArrowInvalid) as error:
        return [], f"{type(error).__name__}: {error}"
