"""Byte-level BPE encoding and decoding.

A text falls into pieces by the vocabulary's pattern, and every piece is encoded alone. A
piece that is a token is that token. All other pieces of a slice that are not remembered
become rows of padded matrices, bucketed by length, in which every row merges its leftmost
pair of the least rank in each round (``merging``: pairs are looked up in a hash table, and
rows compacted).

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded alike; an empty table gives an empty result; columns beyond id and text are not
looked at. Whole texts are encoded, however long: they are cut into stretches where the
pattern always begins a new match, and memory follows a slice and its longest text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .merging import Merger, list_array, sliced

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces remembered in a worker and their greatest length, characters of a stretch.
REMEMBERED, REMEMBERED_CHARS, STRETCH = 600_000, 40, 1_000_000
SCHEMA = "doc_id long, ids array<int>, decoded binary"
_loaded: dict[tuple[bytes, str], Vocabulary] = {}


class Vocabulary:
    """Tokens, the table of their pairs and the pieces remembered."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.piece = regex.compile(pattern)
        self.cut = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
        found = array("i")
        for token, rank in self.rank.items():
            for at in range(1, len(token)):
                left, right = self.rank.get(token[:at]), self.rank.get(token[at:])
                if left is not None and right is not None:
                    found.extend((left, right, rank))
        self.merger = Merger(*np.frombuffer(found, np.int32).reshape(-1, 3).T)
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pieces: from the vocabulary, or by matrices of similar lengths."""
        got: dict[str, tuple[int, ...]] = {}
        rows: list[tuple[int, str, bytes]] = []
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.rank.get(raw)) is not None:
                got[piece] = (rank,)
            else:
                rows.append((len(raw), piece, raw))
        rows.sort(key=lambda r: r[0])
        for a, b in self.merger.buckets([n for n, _, _ in rows]):
            part = rows[a:b]
            symbols = self.byte[np.frombuffer(b"".join(raw for _, _, raw in part), np.uint8)]
            flat, size = self.merger.merged(symbols, np.array([n for n, _, _ in part]))
            ids, stops = flat.tolist(), np.cumsum(size).tolist()
            for (_, piece, _), start, stop in zip(part, [0, *stops], stops, strict=False):
                got[piece] = tuple(ids[start:stop])
        return got

    def stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > STRETCH and (m := self.cut.search(text, start + STRETCH)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of each text of a slice. Unknown pieces of all its texts are merged together, of a long text those of a stretch."""
        if len(texts) == 1:
            ids = array("i")
            for part in self.stretches(texts[0]):
                ids.extend(self.ids_of([self.piece.findall(part)])[0])
            return [ids]
        return self.ids_of([self.piece.findall(t) for t in texts])

    def ids_of(self, cut: list[list[str]]) -> list[array]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = set(chain.from_iterable(cut)).difference(known)
        learnt = self.learn(fresh)
        known.update(learnt)
        out = [array("i", chain.from_iterable(map(known.__getitem__, pieces))) for pieces in cut]
        for piece in learnt:
            if len(piece) > REMEMBERED_CHARS:
                del known[piece]
        return out

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    """One for each worker, rank file and pattern."""
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Vocabulary(ranks, pattern)
    return _loaded[ranks, pattern]


def rank_file(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that they decode to. The rank file travels as bytes: executors need no file."""
    held = docs.sparkSession.sparkContext.broadcast((ranks or rank_file(), pattern or default_pattern()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(*held.value)
        for batch in batches:
            for a, texts in sliced(batch.column(1)):
                ids = own.encode(texts)
                decoded = pa.array([own.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), list_array(ids), decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
