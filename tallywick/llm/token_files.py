"""Token ids in Arrow files of equal-length sequences.

A file in Arrow's random-access format holds batches of two fixed-size lists: ``tokens`` (the smallest unsigned
integer type that holds the vocabulary) and ``mask`` (whether a place holds a token, a bit each). Sequences have no offsets and
buffers are not compressed, so sequence ``i`` of a memory-mapped file is a slice of the file. Documents follow one
another without gaps; only a file's last sequence is padded. A second file of the same format lists the documents:
id, start in the file, number of tokens.

Documents are put in the order of their ids by a range partitioning; each task writes the files of its range while it
encodes, one batch in memory at a time. A file counts once its row is in the manifest that Spark commits.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallywick.llm.storage import attempt_file, materialize, open_store, output_folder

SEQUENCE = 2_048
#: Sequences of a batch: 256 of 2,048 ids of two bytes are 1 MB.
BATCH = 256
END = 2
#: Words of letters that are encoded as one text; their ids are told apart by the ids that end a word.
JOINED = 64
#: Entries a worker remembers of stretches between spaces, and the longest text one may have.
REMEMBERED = 800_000
REMEMBERED_CHARS = 48
_NOT_PLAIN = re.compile(r"<\||[\u0130\u0250-\U0010ffff]")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_LETTERS_AND_MARKS = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
_MANIFEST = "part int, tokens_path string, index_path string, documents long, tokens long"


class Encoder:
    """The tokenizers library with a memory for recurring stretches.

    The vocabulary's cutting drops white space and joins nothing across it, so the ids of a text are those of its
    stretches between spaces or line breaks, one after the other. It lowers letters and ends a piece between letters
    and punctuation, so in plain Latin text a stretch has the ids of its lowered letters and of its punctuation.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.known: dict[str, bytes] = {}
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, each of which ends with the only id of its that ends a word."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        found = []
        for group, coded in zip(groups, self.library.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False)):
            ids = np.array(coded.ids, dtype="<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(group):
                data = ids.tobytes()
                found += [data[a:b] for a, b in zip([0, *ends], ends)]
            else:
                found += self._ids(group)
        return found

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, stretches: set[str]) -> None:
        """Adds the ids of stretches; of letters and punctuation together, from those of the two."""
        known, pairs = self.known, []
        needed = set()
        for stretch in stretches:
            parts = _LETTERS_AND_MARKS.fullmatch(stretch)
            if parts:
                pairs.append((stretch, *parts.groups()))
                needed.update(parts.groups())
            else:
                needed.add(stretch)
        new = needed.difference(known)
        words = list(filter(_LETTERS.fullmatch, new))
        known.update(zip(words, self._word_ids(words)))
        others = list(new.difference(words))
        known.update(zip(others, self._ids(others)))
        known.update((stretch, known[letters] + known[marks]) for stretch, letters, marks in pairs)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is the empty text."""
        cut = [_lowered(t or "").replace("\n", " ").split(" ") for t in texts]
        all_of_them = set().union(*cut)
        new = all_of_them.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = all_of_them
        self._learn({s for s in new if len(s) <= REMEMBERED_CHARS})
        long = [s for s in new if len(s) > REMEMBERED_CHARS]
        self.known.update(zip(long, self._ids(long)))
        found = [b"".join(map(self.known.__getitem__, stretches)) for stretches in cut]
        for stretch in long:
            del self.known[stretch]
        return found


def _lowered(text: str) -> str:
    """Plain Latin text in lower case; any other, or with what may be a control string, as it is."""
    return text if _NOT_PLAIN.search(text) else text.lower()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, one per worker."""
    return Encoder(path)


def token_type(size: int) -> pa.DataType:
    return pa.uint16() if size <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, uri: str, kind: pa.DataType, length: int = SEQUENCE):
        store, path = open_store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.kind, self.length, self.width = kind, length, length * BATCH
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = store.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.buffer = np.zeros(self.width, dtype=kind.to_pandas_dtype())
        self.held = 0

    def write(self, ids: np.ndarray) -> None:
        while len(ids):
            part = ids[: self.width - self.held]
            self.buffer[self.held : self.held + len(part)] = part
            self.held += len(part)
            ids = ids[len(part) :]
            if self.held == self.width:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.held // self.length)
        used = rows * self.length
        self.buffer[self.held : used] = 0
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(self.buffer[:used]), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(used) < self.held), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([tokens, mask], schema=self.schema))
        self.held = 0

    def close(self) -> None:
        if self.held:
            self._flush()
        self.writer.close()
        self.sink.close()


def sequence_slices(uri: str, number: int) -> tuple[pa.Array, pa.BooleanArray]:
    """Sequence ``number`` of a file and its mask, without reading others; both slices of the file from a memory map."""
    store, path = open_store(uri)
    source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(number // BATCH)
    tokens, mask = (column[number % BATCH].values for column in batch.columns)
    return tokens, mask


def read_sequence(uri: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sequence_slices` for numpy: the tokens as a view, the mask's bits as bytes of their own."""
    tokens, mask = sequence_slices(uri, number)
    return tokens.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def _index_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END, length: int = SEQUENCE
) -> DataFrame:
    """Writes the ids of ``docs`` below ``folder`` in ascending id order; returns the committed manifest.

    Rows without an id come first; rows that repeat an id follow each other by their texts. Null and empty texts have
    the end id only. An empty table writes no file. Other columns are not read.
    """
    chosen = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    # the hash settles the order of repeated ids, so that a repeated task writes the same; equal rows are alike
    ordered = chosen.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.xxhash64("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder, writer, index = encoder(tokenizer), None, None
        documents = tokens = 0
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                tokens_path = attempt_file(folder, f"tokens-{part:06d}", ".arrow")
                index_path = attempt_file(folder, f"index-{part:06d}", ".arrow")
                writer = SequenceWriter(tokens_path, token_type(max(coder.size, end + 1)), length)
                schema = _index_schema(batch.column(0).type)
                store, path = open_store(index_path)
                sink = store.open_output_stream(path)
                index = pa.ipc.new_file(sink, schema)
            counts = []
            for at in range(0, batch.num_rows, 256):
                for ids in coder.encode_batch(batch.column(1).slice(at, 256).to_pylist()):
                    ids = np.frombuffer(ids + tail, dtype="<u4")
                    counts.append(len(ids))
                    writer.write(ids)
            lengths = np.array(counts, dtype=np.int64)
            starts = tokens + np.cumsum(lengths) - lengths
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(lengths)], schema=schema))
            documents += batch.num_rows
            tokens += int(lengths.sum())
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            row = [[part], [tokens_path], [index_path], [documents], [tokens]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=_names(_MANIFEST))

    return materialize(ordered.mapInArrow(run, _MANIFEST), "manifest")


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _stream(uri: str) -> Iterator[np.ndarray]:
    """A file's ids, batch by batch, without padding."""
    store, path = open_store(uri)
    with store.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield tokens if mask[-1] else tokens[mask]


def _documents(tokens_path: str, index_path: str) -> Iterator[tuple[object, int, int, int]]:
    """``(doc_id, start in the file, n_tokens, crc32)`` of each document, read in one pass over the file."""
    stream, held = _stream(tokens_path), np.zeros(0, dtype="<u4")
    store, path = open_store(index_path)
    with store.open_input_file(path) as source:
        index = pa.ipc.open_file(source)
        for i in range(index.num_record_batches):
            for doc_id, start, count in zip(*(c.to_pylist() for c in index.get_batch(i).columns)):
                crc, missing = 0, count
                while missing:
                    if not len(held):
                        held = next(stream).astype("<u4")
                    crc = zlib.crc32(held[:missing], crc)
                    missing, held = missing - len(held[:missing]), held[missing:]
                yield doc_id, start, count, crc


def read_documents(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files of a manifest.

    ``start`` counts the ids of all documents before it, over all files; a file is read by one task, batch by batch.
    """
    # a row per file: few, whatever the number of documents
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(manifest.select("tokens_path", "index_path", before.alias("before")), "files")
    several = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens_path, index_path, before in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for doc_id, start, count, crc in _documents(tokens_path, index_path):
                    rows.append((doc_id, before + start, count, crc))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"

    def _rows(rows):
        ids, starts, counts, crcs = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, _ARROW.get(kind)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
            names=_names(schema),
        )

    return files.repartition(several).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def tokens_and_back(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the documents' ids to a new shared folder and reads them back from there."""
    folder = output_folder(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, folder, tokenizer, text, doc_id), docs.schema[doc_id].dataType.simpleString())
