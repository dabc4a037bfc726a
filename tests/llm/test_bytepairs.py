"""Matrices of pieces against the library, on fuzzed texts and on a table."""

import hashlib
import random
import time

import numpy as np
import pytest

bytepairs = pytest.importorskip("groma.llm.bytepairs")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return bytepairs.vocabulary(bytepairs.rank_file(), bytepairs.default_pattern())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=bytepairs.default_pattern(), mergeable_ranks=own.rank, special_tokens={})


def test_fuzzed_texts_agree_with_the_library(own, library):
    rng = random.Random(5)
    letters = ["a", "e", "th", " ", "  ", "\n", "\t", "é", "漢", "\U0001f600", "'s", "'ll", "<|endoftext|>", "\x00", "\x1c", "\x85", ".", ",,", "the ", "    ", "\r\n", "12", "\u200b", "ﬁ", "aaaa", "ABAB"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 80, 400]))) for _ in range(2000)]
    texts += ["", "x" * 5000, " " * 3000, "ab" * 3000, "!?" * 2000, "é" * 3000, "".join(rng.choice("acgtACGT") for _ in range(20_000))]
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        for text, ids in zip(part, own.encode(part), strict=True):
            assert ids.tolist() == library.encode_ordinary(text), text[:99]
            assert own.decode(ids) == text.encode()


def test_stretches_of_a_long_text_keep_its_ids(own, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "STRETCH", 50)
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "it's", "12", "é", ". "]) for _ in range(5000))
    assert len(list(own.stretches(text))) > 20
    assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_rows_of_equal_length_merge_one_by_one_where_order_matters(own):
    # pairs whose merge gives a token with a lower-ranked neighbour are found in the vocabulary itself
    assert own.merger.restless.any()
    pieces = [bytes([a, b, a, b, c]) for a in b"aeinost" for b in b"aeinost" for c in b"rlt"]

    def plain(raw):
        ids = [own.rank[bytes([x])] for x in raw]
        while True:
            found = [(own.rank.get(own.token[x] + own.token[y], 1 << 30), i) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False))]
            if not found or min(found)[0] == 1 << 30:
                return tuple(ids)
            rank, i = min(found)
            ids[i : i + 2] = [rank]

    symbols = own.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    flat, size = own.merger.merged(symbols, np.array([5] * len(pieces)))
    assert [tuple(x.tolist()) for x in np.split(flat, np.cumsum(size)[:-1])] == [plain(p) for p in pieces]
    assert [own.merger.merged_alone(own.byte[list(p)]) for p in pieces] == [plain(p) for p in pieces]


def test_a_long_row_takes_no_square_time(own, library):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    began = time.time()
    assert own.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert time.time() - began < 20


def test_query_on_awkward_rows(spark, awkward, nothing, library, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = bytepairs.query(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in awkward.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bytepairs.encode(nothing).count() == 0
