"""Terms of texts for the operators that count them: runs of letters, also of digits, with A-Z lower-cased.

Every code point from U+0080 on counts as a letter. In UTF-8 these are the bytes from 0x80
on, so terms are cut in bytes: others become spaces, and the text is split there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from .common import LOWER, UPPER

_kept = LOWER.encode() + bytes(range(128, 256))
_lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Tables for bytes.translate: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`, and with digits `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`.
LETTERS = bytes(b if b in _kept else 32 for b in _lower)
LETTERS_AND_DIGITS = bytes(b if b in _kept + b"0123456789" else 32 for b in _lower)
#: Bytes of a text that are split at once.
PART = 4_000_000


def term_lists(body: bytes, kept: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a list for each part of it; a part ends between terms."""
    start = 0
    plain = body.translate(kept)
    while len(plain) - start > PART and (stop := plain.find(b" ", start + PART)) >= 0:
        yield plain[start:stop].split()
        start = stop
    yield (plain[start:] if start else plain).split()


def arrow_texts(column: pa.Array) -> list[bytes]:
    """A column of texts as bytes, null as an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
