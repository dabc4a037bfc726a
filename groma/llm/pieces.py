"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs that form a piece wait in an agenda ordered by score, then position;
the best is merged and its new neighbours join the agenda, until none is left. Symbols
that are no pieces become bytes. Merges never cross a boundary that no piece spans, so a
text is cut there and the ids of short stretches are remembered. All stretches of a slice
of an Arrow batch that are not remembered are merged together: their agendas are the rows of
a matrix (``merging``). For every text the library encodes the whole text beside it, and
``agrees`` says whether the ids are the same.

Defined results: a null or empty text gives the end id alone and decodes to an empty text;
repeated rows are encoded alike; an empty table gives an empty result. Whole texts are
encoded, however long; a batch is worked on in slices, so that memory follows the slice.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .merging import Merger, list_array, sliced

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches remembered in a worker, and bytes of their ids.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64_000_000
SCHEMA = "doc_id long, ids array<int>, decoded string, agrees boolean"
_loaded: dict[bytes, Vocabulary] = {}


class Vocabulary:
    """Pieces, their scores and the stretches remembered; the library's processor beside it for checks and decoding."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kind = proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.normalizer_spec.name != "identity" or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a merge-type vocabulary without normalisation is needed")
        if any(p.type == kind.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined pieces are not provided for")
        normal = [(i, p) for i, p in enumerate(spec.pieces) if p.type in (kind.NORMAL, kind.UNUSED)]
        # a piece's symbol is its place by falling score; other characters stand behind all pieces
        normal.sort(key=lambda ip: -ip[1].score)
        self.symbol = {p.piece: place for place, (_, p) in enumerate(normal)}
        self.id = [i for i, _ in normal]
        self.of_character = np.arange(len(normal), len(normal) + sys.maxunicode + 1, dtype=np.int32)
        alone = [(ord(p), place) for p, place in self.symbol.items() if len(p) == 1]
        self.of_character[[c for c, _ in alone]] = [place for _, place in alone]
        self.of_character[ord(" ")] = self.of_character[ord(SPACE)]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN)
        scores = np.array([-p.score for _, p in normal])
        # equal scores are one tier: position decides between them
        tier = np.cumsum(np.append(0, np.diff(scores) > 0)).astype(np.int32)
        self.merger = Merger(*np.array(self.merges(), np.int32).reshape(-1, 3).T, tier)
        #: Whether pieces of equal score are runs of spaces, so that other stretches need no tiers.
        tied = np.bincount(tier)[tier] > 1
        self.ties_are_spaces = all(not p.strip(SPACE) for p, t in zip(self.symbol, tied.tolist(), strict=True) if t and len(p) > 1)
        self.end = self.library.eos_id()
        self.prefix = " " if spec.normalizer_spec.add_dummy_prefix else ""
        self.stretch = re.compile(self.cuts())
        self.ids = np.array(self.id, np.int64)
        #: Stretches by number, and the ids of all of them.
        self.known: dict[str, int] = {}
        self.flat, self.sizes = bytearray(), bytearray()

    def merges(self) -> list[tuple[int, int, int]]:
        """The symbols of each pair that makes a piece, and of the piece."""
        part = lambda s: self.symbol.get(s, len(self.symbol) + ord(s) if len(s) == 1 else None)
        halves = ((part(p[:i]), part(p[i:]), place) for p, place in self.symbol.items() for i in range(1, len(p)))
        return [x for x in halves if x[0] is not None and x[1] is not None]

    def cuts(self) -> str:
        """Pattern of the stretches, by what the vocabulary allows: a cut is safe where no piece has both of its sides. A space stands for the mark that pieces have for it."""
        letter = re.compile(r"[^\W\d_]")
        is_letter = lambda c: letter.match(c) is not None
        inside = [p.lstrip(SPACE) for p in self.symbol]
        if any(SPACE in p for p in inside):
            return "(?s).+"
        alone = "" if any("\n" in p and len(p) > 1 for p in self.symbol) else "\n"
        line = f"{alone}|" if alone else ""
        if any(is_letter(a) != is_letter(b) for p in inside for a, b in zip(p, p[1:], strict=False)):
            # behind these letters, a cut is safe before a character that follows a letter in no piece; classes of few characters match fast
            behind = {b for p in inside for a, b in zip(p, p[1:], strict=False) if is_letter(a)}
            safe = sorted({c for p in inside for c in p if c.isascii() and not is_letter(c)} - behind - {alone})
            word = f"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[{re.escape(''.join(safe))}])|" if safe else ""
            return f"{line} *(?:{word}[^ {alone}]+)| +"
        return rf"{line} *[^\W\d_]+| *(?:[\d_]|[^\w {alone}])+| +"

    def ids_of_symbol(self, symbol: int) -> tuple[int, ...]:
        if symbol < len(self.id):
            return (self.id[symbol],)
        return tuple(self.bytes[x] for x in chr(symbol - len(self.id)).encode()) if self.bytes else (self.unknown,)

    def learn(self, stretches: set[str]) -> None:
        """Ids of stretches, by agendas of similar length; stored in one flat array, a stretch is known by its number."""
        base = len(self.id)
        spaced = {x for x in stretches if "  " in x} if self.ties_are_spaces else stretches
        for rows, tiers in ((stretches - spaced, False), (spaced, True)):
            rows = sorted(rows, key=len)
            for a, b in self.merger.buckets([len(x) for x in rows]):
                self.add(rows[a:b], base, tiers)

    def add(self, part: list[str], base: int, tiers: bool) -> None:
        symbols = self.of_character[np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)]
        flat, size = self.merger.merged(symbols, np.array([len(s) for s in part]), tiers)
        if len(flat) and flat.max() >= base:
            # characters that are no pieces stand for their bytes, or for the unknown id
            spelled = [self.ids_of_symbol(x) for x in flat.tolist()]
            many = np.fromiter(map(len, spelled), np.int64, len(spelled))
            size = np.add.reduceat(many, np.cumsum(size) - size)
            flat = np.fromiter(chain.from_iterable(spelled), np.int64)
        else:
            flat = self.ids[flat]
        self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
        self.flat.extend(flat.astype(np.int32).tobytes())
        self.sizes.extend(size.astype(np.int32).tobytes())

    def forget(self) -> None:
        self.known, self.flat, self.sizes = {}, bytearray(), bytearray()

    def encode(self, texts: list[str], remembered: int = REMEMBERED) -> list[np.ndarray]:
        """Ids of each text of a slice, the end id last."""
        if len(self.known) > remembered or len(self.flat) > REMEMBERED_BYTES:
            self.forget()
        cut = [self.stretch.findall(self.prefix + text.replace(SPACE, " ")) if text else [] for text in texts]
        counts = [len(parts) for parts in cut]
        every = list(chain.from_iterable(cut))
        number = np.fromiter(map(self.known.get, every, repeat(-1)), np.int32, len(every))
        fresh = np.flatnonzero(number < 0).tolist()
        if fresh:
            self.learn({every[i] for i in fresh})
            number[fresh] = [self.known[every[i]] for i in fresh]
        flat, sizes = np.frombuffer(self.flat, np.int32), np.frombuffer(self.sizes, np.int32)
        starts = np.cumsum(sizes) - sizes
        size = sizes[number]
        done = np.cumsum(size)
        ids = flat[np.repeat(starts[number] - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        stops = np.append(0, done)[np.cumsum(counts)]
        return [np.append(part, np.int32(self.end)) for part in np.split(ids, stops[:-1])]


def vocabulary(model: bytes) -> Vocabulary:
    """One for each worker and model."""
    if model not in _loaded:
        _loaded[model] = Vocabulary(model)
    return _loaded[model]


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: bytes | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids (end id last), decoded text, and whether the library gives the same ids. The model travels as bytes: executors need no file.

    remembered: stretches that a worker remembers between slices; fewer take less memory and more time, and change no result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(held.value)
        for batch in batches:
            for a, texts in sliced(batch.column(1)):
                ids = own.encode(texts, remembered)
                theirs = own.library.encode(texts, add_eos=True, num_threads=1, return_type="numpy")
                agrees = [np.array_equal(x, y) for x, y in zip(ids, theirs, strict=True)]
                decoded = [own.library.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), list_array(ids), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                    ["doc_id", "ids", "decoded", "agrees"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Per document the digests of ids and decoded text; more: columns that are kept beside them."""
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
