"""The agenda against the library, on fuzzed texts and on a table."""

import random

import pyarrow as pa
import pytest

pieces = pytest.importorskip("groma.llm.pieces")


@pytest.fixture(scope="module")
def own():
    return pieces.vocabulary(pieces.model_bytes())


def test_fuzzed_texts_agree_with_the_library(own):
    rng = random.Random(7)
    letters = ["a", "e", "th", " ", "  ", "\n", "\t", "é", "ß", "漢", "\U0001f600", pieces.SPACE, "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\x01", ".", ",,", "the ", "    ", "\r\n", "12", "​", "ﬁ"]
    texts = ["", " ", "  ", "\n", "a", " a", "a ", "x" * 5000, " " * 300, "ab" * 3000, "the " * 4000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 80]))) for _ in range(3000)]
    for text in texts:
        assert own.encode([text])[0].tolist() == own.library.encode(text, add_eos=True), text
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert [x.tolist() for x in own.encode(part)] == own.library.encode(part, add_eos=True)


def test_table_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world\n", "z"), (3, "Hello  world\n", "z"), (None, "q", None)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(got) == 5 and all(r.agrees for r in got)
    by = {r.doc_id: r for r in got}
    assert list(by[1].ids) == list(by[2].ids) == [2] and by[1].decoded == ""
    assert by[3].decoded == "Hello  world\n"


def test_empty_table(spark):
    assert pieces.digests(pieces.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_a_batch_becomes_strings_slice_by_slice():
    from groma.llm import merging

    texts = ["é" * (i % 7) if i % 11 else None for i in range(600)]
    found = list(merging.sliced(pa.array(texts, pa.string())))
    assert [a for a, _ in found] == [0, 256, 512] and max(len(x) for _, x in found) <= merging.SLICE_ROWS
    assert [x for _, some in found for x in some] == [x or "" for x in texts]
    assert [len(x) for _, x in merging.sliced(pa.array(["a" * merging.SLICE_CHARS, "b", None]))] == [1, 2]
    assert list(merging.sliced(pa.array([], pa.string()))) == []


def test_remembering_less_changes_no_ids():
    own = pieces.vocabulary(pieces.model_bytes())
    texts = [f"Word{i} and {i * 7} more, été  {chr(1040 + i % 30)}x" for i in range(300)]
    whole = [x.tolist() for x in own.encode(texts)]
    own.forget()
    few = [x.tolist() for i in range(0, 300, 20) for x in own.encode(texts[i : i + 20], 10)]
    assert few == whole and len(own.known) < 200
    own.forget()
