"""An idempotent sink for streams: versioned tables, a ledger of batches, and optimistic writes.

A table is a folder of versions (``v=00000001`` and so on), each a whole snapshot, with a
ledger in which one small file stands for each version: ``00000001.json`` says from which
version it was made and which batches of which writers it holds. A version counts from the moment its ledger file
is there, and that file comes into being by one rename that fails where the name is taken;
a folder without one is left over from a crash and is never read. So

* a batch that is played again finds its number in the latest line and does nothing;
* a crash before the rename leaves nothing that is read, and the batch is done again;
* of two writers that began from the same version one gets the name, the other a conflict.

The rename is the file system's own (HDFS, and local folders); a store without atomic
renames needs another ledger.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version after the one that a change began from."""


@dataclass(frozen=True)
class Entry:
    """A ledger's line: the version, what it was made from, its folder, and the last batch of each writer that it holds."""

    version: int
    base: int
    folder: str
    played: dict[str, int]


class Versions:
    """A table of versions at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(name)

    def versions(self) -> list[int]:
        """The numbers of the versions that count, oldest first."""
        folder = self._path(f"{self.path}/_ledger")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def entry(self, version: int) -> Entry:
        stream = self._files.open(self._path(f"{self.path}/_ledger/{version:08d}.json"))
        try:
            return Entry(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def latest(self) -> Entry | None:
        found = self.versions()
        return self.entry(found[-1]) if found else None

    def read(self, version: int | None = None) -> DataFrame:
        """A version's snapshot, the latest one by default."""
        found = self.versions()
        if not found or version is not None and version not in found:
            raise LookupError(f"{self.path} has no version {version or 1}")
        return self.spark.read.parquet(f"{self.path}/{self.entry(version or found[-1]).folder}")

    def commit(self, rows: DataFrame, *, base: int, played: dict[str, int] | None = None) -> Entry:
        """Writes rows as the version after ``base``; Conflict if there is one already."""
        entry = Entry(base + 1, base, f"v={base + 1:08d}-{uuid.uuid4().hex}", played or {})
        rows.write.parquet(f"{self.path}/{entry.folder}")
        draft = self._path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps(asdict(entry)).encode()))
        stream.close()
        self._files.mkdirs(self._path(f"{self.path}/_ledger"))
        if not self._renamed(draft, self._path(f"{self.path}/_ledger/{entry.version:08d}.json")):
            self._files.delete(draft, False)
            self._files.delete(self._path(f"{self.path}/{entry.folder}"), True)
            raise Conflict(f"version {entry.version} of {self.path} is there already")
        return entry

    def _renamed(self, draft, name) -> bool:
        """A rename that does not replace: where the name is taken, false."""
        options = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        options[0] = self._fs.Options.Rename.NONE
        context = self._fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, name, options)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def sweep(self, keep: int = 10) -> int:
        """Deletes old versions but ``keep``, with their ledger lines but the latest, and what no line names; not beside a running writer. The number of folders and drafts."""
        found = self.versions()
        named = {self.entry(v).folder for v in found[-keep:]} | {"_ledger"}
        gone = [f.getPath() for f in self._files.listStatus(self._path(self.path)) if f.getPath().getName() not in named]
        for path in [*(self._path(f"{self.path}/_ledger/{v:08d}.json") for v in found[:-keep]), *gone]:
            self._files.delete(path, True)
        return len(gone)


def upserted(before: DataFrame | None, changes: DataFrame, *, keys: Sequence[str], order: Sequence[Column], deleted: Column | None = None) -> DataFrame:
    """The snapshot after the changes: of each key the last change, unless it deletes. One full join; keys that did not change are taken over."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.withColumn("_gone", deleted if deleted is not None else F.lit(False)).groupBy(*keys).agg(F.max_by(F.struct(*rest, "_gone"), F.struct(*order)).alias("_new"))
    if before is None:
        return last.filter("not _new._gone").select(*keys, *[F.col(f"_new.{c}").alias(c) for c in rest])
    old = before.select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.struct(*rest).alias("_old"))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_old_{k}"))
        same = one if same is None else same & one
    both = last.join(old, same, "full")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
    key = lambda k: F.when(F.col("_new").isNotNull(), F.col(k)).otherwise(F.col(f"_old_{k}")).alias(k)
    return both.filter("_new is null or not _new._gone").select(*map(key, keys), *map(pick, rest))


def applied(table: Versions, writer: str, change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch makes one version of the table, once, however often it is played."""

    def take(rows: DataFrame, batch: int) -> None:
        last = table.latest()
        played = last.played if last else {}
        if played.get(writer, -1) < batch:
            before = table.read(last.version) if last else None
            table.commit(change(before, rows), base=last.version if last else 0, played=played | {writer: batch})

    return take
