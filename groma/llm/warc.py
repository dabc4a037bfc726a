"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames, frames into bundle files, and each file ends
with a seek table in a skippable frame, so that one frame can be found and read alone. The
index maps a page's id to bundle, frame and the record's offset within the frame.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest id is
a response and the others revisit it. Defined results: a null payload is an empty one; ids
that are null come after all others; rows that share an id and a payload are all written,
with the same type; an empty table gives no bundle and an empty result; columns beyond id,
address and payload are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_if_null, scratch, scratch_path, table

LEAST = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
#: Bytes of frames that one task reads back.
READ_BYTES = 1 << 24
#: A table of repeated payloads of at most this many rows (some 80 bytes each) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset int, length int"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP header of what it refers to, without the payload."""
    kind = "response" if refers_to is None else "revisit"
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset, and the offset after it."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    size = int(head["Content-Length"])
    block = data[stop + 4 : stop + 4 + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    number = lambda x: None if (n := x.removeprefix("<urn:page:").removesuffix(">")) == "None" else int(n)
    found = {
        "page_id": number(head["WARC-Record-ID"]),
        "url": head["WARC-Target-URI"],
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
        "payload": payload,
    }
    return found, stop + 4 + size + 4


class Bundle:
    """A bundle in the making: finished frames and the records of the frame to come."""

    def __init__(self) -> None:
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.rows.append((page_id, self.name, len(self.frames), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.open = bytearray()

    def full(self) -> bool:
        return sum(s for s, _ in self.sizes) + len(self.open) >= BUNDLE_BYTES

    def write(self, root: str) -> list[tuple]:
        """Puts the file in its place only when it is whole; returns the index rows."""
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/.{self.name}", compression=None) as out:
            for frame in self.frames:
                out.write(frame)
            out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        store.move(f"{path}/.{self.name}", f"{path}/{self.name}")
        return self.rows


def seek_table(source: pa.NativeFile) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the end of the file."""
    source.seek(source.size() - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(source.size() - 9 - count * width)
    data, at, found = source.read(count * width), 0, []
    for i in range(count):
        size = struct.unpack_from("<I", data, i * width)[0]
        found.append((at, size))
        at += size
    return found


def read_frame(source: pa.NativeFile, at: int, size: int) -> bytes:
    source.seek(at)
    return zstandard.ZstdDecompressor().decompress(source.read(size))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def write(pages: DataFrame, root: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the bundles below root, a folder that all executors share, and returns the index.

    A task that runs again writes new files; the index has those of the attempt that counted.
    """
    body = empty_if_null(F.col(payload))
    hashed = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("size"), F.sha2(body.cast("binary"), 256).alias("digest"))
    groups = hashed.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = scratch(groups.filter("n > 1").select("digest", "first"), "repeated")
    small = repeated.count() <= BROADCAST_ROWS
    typed = hashed.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))
    rows = typed.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).otherwise("").alias("payload"), "size", "digest", refers.alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, address, data, size, digest, to = (c[i].as_py() for c in columns)
                bundle.add(page, record(page, address, data.encode(), size, digest, to))
                if bundle.full():
                    yield _batch(bundle.write(root), INDEX)
                    bundle = Bundle()
        if bundle.rows:
            yield _batch(bundle.write(root), INDEX)

    return scratch(rows.mapInArrow(work, INDEX), "warc-index")


def read(index: DataFrame, root: str, *, payloads: bool = False) -> DataFrame:
    """All records of the frames that the index names, each frame found by its bundle's seek table."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    data, here, rows = read_frame(source, *seek_table(source)[frame]), 0, []
                while here < len(data):
                    found, here = parse(data, here)
                    rows.append(tuple(found[n] for n in names))
                yield _batch(rows, schema)

    return dealt(index.select("bundle", "frame").distinct()).mapInArrow(work, schema)


def dealt(frames: DataFrame) -> DataFrame:
    """Rows that name frames, in as many partitions as the frames' bytes ask for: names are small, so Spark by itself would give them to one task."""
    n = frames.select("bundle", "frame").distinct().count()
    return frames.repartition(max(1, -(-n * FRAME_BYTES // READ_BYTES)), "bundle", "frame")


def fetch(index: DataFrame, root: str, ids: DataFrame, *, page_id: str = "page_id") -> DataFrame:
    """The records of some ids: only their frames are read, each one found by its bundle's seek table."""
    schema = RECORD + ", payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, frame, offset in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    found, _ = parse(read_frame(source, *seek_table(source)[frame]), offset)
                yield _batch([tuple(found[n] for n in names)], schema)

    wanted = ids.select(F.col(page_id).cast("long").alias("page_id")).distinct()
    return dealt(scratch(index.join(wanted, "page_id", "left_semi").select("bundle", "frame", "offset"), "wanted")).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), root)
    return read(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, url FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM hashed WHERE size >= 100 GROUP BY digest)
SELECT h.page_id, h.size AS payload_bytes, h.digest AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND h.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND h.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to, h.url
FROM hashed h LEFT JOIN firsts f USING (digest)
"""
