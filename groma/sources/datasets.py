"""Data sets of label files that appear whole or not at all.

``labelled_set`` is a data source for writing: rows of split, name and content become text
files. Tasks write under a staging folder beside the target, each attempt in a folder of its
own, and report what they wrote. The driver commits when all tasks have reported: it removes
what attempts left that do not count, writes the manifest and renames the staging folder to
the target. If a task fails for good, or the driver does before the rename, nothing is
visible; an abort removes the staging folder.

Layout: ``labels/<split>/<task>/<name>.txt`` and ``manifest.json`` (files and lines by split,
and the folders). The folder is one that driver and executors share, as any URI that Arrow
knows. Names are unique within a split: ``publish`` checks that first, by one aggregate.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "labelled_set"
COLUMNS = ["split", "name", "content"]


@dataclass
class Written(WriterCommitMessage):
    """A task's report: its folder's name, and files and lines by split."""

    task: str
    files: dict[str, int]
    lines: dict[str, int]


class LabelledSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> LabelledSetWriter:
        missing = [c for c in COLUMNS if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"a data set needs the columns {missing}")
        return LabelledSetWriter(self.options["path"], overwrite)


class LabelledSetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.staging)
        report = Written(f"task-{uuid.uuid4().hex}", {}, {})
        n_files, n_lines = Counter(), Counter()
        for batch in iterator:
            for split, name, content in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                if not split or not name or "/" in split or "/" in name:
                    raise ValueError(f"split {split!r} and name {name!r} cannot be names of files")
                folder = f"{root}/labels/{split}/{report.task}"
                if split not in n_files:
                    files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{name}.txt") as out:
                    out.write((content or "").encode())
                n_files[split] += 1
                n_lines[split] += len((content or "").splitlines())
        report.files, report.lines = dict(n_files), dict(n_lines)
        return report

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.staging)
        target = fs.FileSystem.from_uri(self.path)[1]
        there = files.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            files.delete_dir(root)
            raise FileExistsError(self.path)
        reports = [m for m in messages if m is not None]
        kept = {(split, m.task) for m in reports for split in m.files}
        files.create_dir(f"{root}/labels", recursive=True)
        for split in files.get_file_info(fs.FileSelector(f"{root}/labels")):
            for task in files.get_file_info(fs.FileSelector(split.path)):
                if (split.base_name, task.base_name) not in kept:
                    files.delete_dir(task.path)
        total = lambda of: {split: sum(getattr(m, of).get(split, 0) for m in reports) for split in sorted({s for s, _ in kept})}
        with files.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"files": total("files"), "lines": total("lines"), "folders": sorted("/".join(k) for k in kept)}, indent=1).encode())
        aside = f"{root}-old"
        if there:
            files.move(target, aside)
        files.move(root, target)
        if there:
            files.delete_dir(aside)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.staging)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)


def publish(rows: DataFrame, path: str, *, overwrite: bool = False) -> dict:
    """Writes split, name and content as a data set, and gives its manifest. Names that occur twice in a split are an error, and nothing is written."""
    twice = rows.groupBy("split", "name").count().filter("count > 1").count()
    if twice:
        raise ValueError(f"{twice} names occur more than once in their split")
    spark = rows.sparkSession
    spark.dataSource.register(LabelledSet)
    rows.select(*COLUMNS).write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)
    return manifest(path)


def manifest(path: str) -> dict:
    files, root = fs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """split, name, line: the lines of a published data set."""
    lines = spark.read.option("recursiveFileLookup", True).text(f"{path}/labels").select("value", F.input_file_name().alias("_file"))
    at = F.split("_file", "/")
    return lines.select(F.element_at(at, -3).alias("split"), F.regexp_replace(F.element_at(at, -1), r"\.txt$", "").alias("name"), F.col("value").alias("line"))
