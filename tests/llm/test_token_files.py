"""Token files against the tokenizers library, and random access to sequences."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywick.llm import token_files
from tallywick.llm.storage import output_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = st.sampled_from(
    ["a", "The", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "\x00", "'s", "'RE", "é", "É", "́", "中", "😀", "1", "!",
     "<|endoftext|>", "<|startoftext|>", "<|", "İ", "Σ", "ſ", " ", "각"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(PARTS, max_size=20).map("".join)), max_size=4))
def test_stretches_have_the_ids_of_the_whole(texts):
    found = token_files.encoder(PATH).encode_batch(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


ROWS = [(5, "Hello there"), (3, "the end. " * 4_000), (9, None), (4, ""), (4, "again"), (4, ""), (1, "x" * 3_000), (7, "one two three"), (None, "no id")]


def _expected():
    found, start = [], 0
    for doc_id, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "") != "")):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_documents_come_back(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("start", F.lit("mine")).repartition(3)
    got = [tuple(r) for r in token_files.tokens_and_back(docs, PATH).collect()]
    # rows of id 4 may stand in either order of their hashes
    ids = lambda rows: sorted(((r[0], r[2], r[3]) for r in rows), key=str)
    assert ids(got) == ids(_expected())
    starts = sorted((r[1], r[2]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    others = lambda rows: sorted((r for r in rows if r[0] != 4), key=str)
    assert others(got) == others(_expected())


def test_files_hold_equal_sequences(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    folder = output_folder(spark, "tokens")
    files = token_files.write_tokens(docs, folder, PATH, length=64).orderBy("part").collect()
    stream = []
    for file in files:
        number = -(-file.tokens // 64)
        for i in range(number):
            tokens, mask = token_files.read_sequence(file.tokens_path, i)
            assert len(tokens) == len(mask) == 64 and tokens.dtype == np.uint16
            assert mask.all() or i == number - 1
            stream += tokens[mask].tolist()
        with pa.memory_map(file.tokens_path.removeprefix("file://")) as source:
            schema = pa.ipc.open_file(source).schema
        assert schema.field("tokens").type == pa.list_(pa.uint16(), 64) and schema.field("mask").type == pa.list_(pa.bool_(), 64)
    assert len(stream) == sum(r[2] for r in _expected()) and stream.count(2) >= len(ROWS)


def test_sequence_is_a_view_of_the_file(tmp_path):
    uri = f"file://{tmp_path}/a.arrow"
    writer = token_files.SequenceWriter(uri, pa.uint16(), 8)
    for part in (np.arange(3), np.arange(3, 8 * token_files.BATCH + 20)):
        writer.write(part)
    writer.close()
    before = pa.total_allocated_bytes()
    tokens, mask = token_files.read_sequence(uri, token_files.BATCH)
    assert tokens.tolist() == list(range(8 * token_files.BATCH, 8 * token_files.BATCH + 8)) and mask.all()
    assert not tokens.flags.owndata and mask.dtype == bool
    # both lie in the mapped file, and nothing of them in memory of Arrow's own
    before = pa.total_allocated_bytes()
    slices = token_files.sequence_slices(uri, token_files.BATCH)
    assert pa.total_allocated_bytes() - before < 4_096
    assert slices[0].to_pylist() == tokens.tolist() and slices[1].to_pylist() == mask.tolist()
    assert pa.total_allocated_bytes() - before < 4_096
    tokens, mask = token_files.read_sequence(uri, token_files.BATCH + 2)
    assert mask.tolist() == [True] * 4 + [False] * 4 and not tokens[4:].any()


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r)[:3] for r in token_files.tokens_and_back(docs, PATH).collect()] == [(1, 0, 1)] * len(rows)


def test_words_encoded_together_are_told_apart():
    coder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["a", "unimaginably", "straße", "zzzzqqqq", "é", "the"] * 50
    assert coder._word_ids(words) == coder._ids(words)
    coder.ends[:] = False  # a vocabulary without word ends
    assert coder._word_ids(words[:3]) == coder._ids(words[:3])
