"""Byte-pair coding against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallywick.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = st.sampled_from(
    ["a", "the", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "\x00", "'s", "'re", "é", "é", "中", "😀",
     "1", "23", "²", "!", "?!", "<|endoftext|>", "<|", "|>", "​", "İ", "ſ"]
)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(PARTS, max_size=25).map("".join)))
def test_same_ids_and_text_as_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    ids = bpe.codec(PATH).encode(text)
    assert ids.tolist() == expected
    assert bpe.codec(PATH).decode(ids) == LIBRARY.decode(expected, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert bpe.codec(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_control_strings_as_text_round_trip(text):
    coder = bpe.codec(PATH)
    text += "<|endoftext|>"
    ids = coder.encode(text, special=False)
    assert 50256 not in ids and coder.decode(ids) == text


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Codec(PATH)
    text = "one two three four five six seven one two three " * 3 + "x" * 5000
    assert coder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(coder.stretches) <= 3


ROWS = [(1, "Hello there,\nyou"), (2, None), (3, ""), (3, ""), (4, "x y " * 50_000), (None, "<|endoftext|> z")]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.round_trip(docs, PATH).collect()), key=str)
    expected = []
    for i, text in ROWS:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        sums = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text or ""))
        expected.append((i, len(ids), *sums))
    assert got == sorted(expected, key=str)


def test_encode_then_decode_keeps_other_columns(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, ids int")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids", "ids_"]
    back = bpe.decode(coded, PATH, "ids_")
    assert all(r.decoded == (r.text or "") and r.ids == 7 for r in back.collect())


@pytest.mark.parametrize("make", [lambda d: bpe.round_trip(d, PATH), lambda d: bpe.encode(d, PATH)])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], "doc_id long, text string")).count() == 0
