"""Alignment of two tokenizers' tokens over the same bytes.

Every text is encoded twice, with a space before it: by a byte-level vocabulary (A) and by a vocabulary of pieces (B). A
task works on Arrow tables of many documents at once: lists of ids are flattened beside their parents' numbers, the
tokens' lengths in bytes are summed up within each document, and a hash join on (document, end) finds the ends that A
and B have in common. These cut the documents into groups; within one, a token is linked to each token of the other
vocabulary whose bytes it overlaps. Pairs of linked ids are counted per document by a grouping of the table, and once
per block of documents and pair; Spark adds up the blocks' counts.

A block's links stay in a file in the shared folder, by the place of their pair in the block's list of pairs. The lists
meet the corpus-wide counts by a join, in which a pair occurs once per block, however common it is. Then each block's
counts meet its file, one block at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tallywick.llm.bpe import PIECES, byte_symbols
from tallywick.llm.storage import materialize, open_store, output_folder

#: Bytes of text aligned at once, and bytes whose pairs share a list and a file (one text at least).
CHUNK, BLOCK = 2 << 20, 16 << 20
#: Texts with a longer word or gap are encoded by a queue of merges, whose time grows in proportion.
LONG_PIECE = 400

_GAP = re.compile(rf"\s{{{LONG_PIECE}}}")
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_FILE = pa.schema(
    [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
)


class Pair:
    """Two vocabularies: their encoders, and the bytes of every token."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(byte_level)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, symbols = model["vocab"], byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        strings = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            strings[i] = bytes(map(byte_of.__getitem__, token))
        self.a_bytes = pa.array(strings, pa.binary())
        self.b_bytes = pa.array([_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())], pa.binary())
        # ids in the order of their merges are ranks, for which there is a faster encoder
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranked = all(vocabulary[token] == i for i, token in enumerate(made, len(symbols)))
        ranks = {string: i for i, string in enumerate(strings)}
        self.a = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def _by_a(self, text: str) -> np.ndarray:
        if self.a is None or _GAP.search(text) or max(map(len, text.split()), default=0) >= LONG_PIECE:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.a.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of both vocabularies for each text, a space before it; an empty text has none."""
        a = [self._by_a(" " + t) if t else np.empty(0, np.uint32) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        return _lists(a, np.concatenate(a)), _lists(b, np.fromiter(chain.from_iterable(b), np.int32))


def _piece_bytes(piece: str) -> bytes:
    byte = _BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode()


def _lists(ids: list, flat: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


@lru_cache(maxsize=2)
def _pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


# --- a chunk of documents ----------------------------------------------------------------------------


def _flat(ids: pa.ListArray, strings: pa.BinaryArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.BinaryArray]:
    """Flattened ids, their parents, the tokens' lengths, each document's bytes, and the tokens' bytes."""
    flat = pc.list_flatten(ids)
    parents = pc.list_parent_indices(ids).to_numpy()
    tokens = strings.take(flat)
    lengths = pc.binary_length(tokens).to_numpy()
    return flat, parents, lengths, np.bincount(parents, lengths, len(ids)).astype(np.int64), tokens


def _joined(tokens: pa.BinaryArray) -> memoryview:
    """The tokens' bytes one after the other."""
    data = tokens.buffers()[2]
    # unsigned, as bytes are
    return memoryview(b"" if data is None else data).cast("B")[: pc.sum(pc.binary_length(tokens)).as_py() or 0]


def _agreeing(texts: list[bytes], sizes: np.ndarray, *sides: tuple[np.ndarray, memoryview]) -> np.ndarray:
    """Which documents have tokens whose joined bytes are the text, on both sides."""
    good = sizes > 0
    for lengths, _ in sides:
        good &= lengths == sizes
    whole = b"".join(texts)
    if good.all() and all(data == whole for _, data in sides):
        return good
    for lengths, data in sides:
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(good):
            good[i] = data[ends[i] - lengths[i] : ends[i]] == texts[i]
    return good


def _segmented(lengths: np.ndarray, parents: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's end within its document: running sums that begin anew with each document."""
    return np.cumsum(lengths) - (np.cumsum(sizes) - sizes)[parents]


def _common_ends(a_parents, a_ends, b_parents, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B, in order, that end at the same byte of the same document."""
    a = pa.table({"doc": a_parents, "end": a_ends, "a": np.arange(len(a_ends), dtype=np.int32)})
    b = pa.table({"doc": b_parents, "end": b_ends, "b": np.arange(len(b_ends), dtype=np.int32)})
    met = a.join(b, keys=["doc", "end"], join_type="inner", use_threads=False)
    partner = np.full(len(a_ends), -1, np.int32)
    partner[met["a"].to_numpy()] = met["b"].to_numpy()
    at = np.flatnonzero(partner >= 0)
    return at, partner[at]


@lru_cache(maxsize=1)
def _digits(size: int) -> np.ndarray:
    """The decimal digits of every id, zero bytes behind them, after a place for a mark."""
    text = np.arange(size).astype(f"S{len(str(size))}")
    width = text.dtype.itemsize
    return np.concatenate([np.zeros((size, 1), np.uint8), text.view(np.uint8).reshape(size, width)], axis=1)


def _written(a_ids, b_ids, a_end, b_end, a_parents, b_parents, rows: int) -> Iterator[bytes]:
    """Each document's groups as text: ids of a group joined by commas, A before B behind a bar, groups by semicolons."""
    groups = len(a_end)
    a_group = np.searchsorted(a_end, np.arange(len(a_ids)))
    b_group = np.searchsorted(b_end, np.arange(len(b_ids)))
    a_start = np.concatenate([[0], a_end[:-1] + 1]) if groups else a_end
    b_start = np.concatenate([[0], b_end[:-1] + 1]) if groups else b_end
    # in the text, tokens of A stand behind those of B in earlier groups, tokens of B behind those of A in their own too
    a_at = np.arange(len(a_ids)) + b_start[a_group]
    b_at = np.arange(len(b_ids)) + a_end[b_group] + 1
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    marks = np.full(len(ids), ord(","), np.uint8)
    ids[a_at], ids[b_at] = a_ids, b_ids
    marks[a_at[a_start]], marks[b_at[b_start]] = ord(";"), ord("|")
    parents = np.empty(len(ids), np.int64)
    parents[a_at], parents[b_at] = a_parents, b_parents
    first = np.flatnonzero(np.diff(parents, prepend=-1))
    marks[first] = 0
    table = _digits(max(60_000, int(ids.max(initial=0)) + 1))
    shown = table[ids]
    shown[:, 0] = marks
    sizes = np.bincount(parents, (shown != 0).sum(axis=1), rows).astype(np.int64)
    text = shown.ravel()
    text = text[text != 0].tobytes()
    ends = np.cumsum(sizes)
    return (text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist()))


def align(texts: list[str | None], pair: Pair) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Per document the numbers of tokens, groups and links and its groups as text; and ``(document, pair)`` per link.

    A pair is ``a * 2**32 + b``. Documents whose tokens' bytes aren't those of the text have none of all.
    """
    rows = len(texts)
    a, b = pair.encode([t or "" for t in texts])
    given = [(" " + t).encode() if t else b"" for t in texts]
    sizes = np.array([len(g) for g in given], np.int64)
    a_ids, a_parents, a_lengths, a_sizes, a_tokens = _flat(a, pair.a_bytes)
    b_ids, b_parents, b_lengths, b_sizes, b_tokens = _flat(b, pair.b_bytes)
    good = _agreeing(given, sizes, (a_sizes, _joined(a_tokens)), (b_sizes, _joined(b_tokens)))
    a_ids, b_ids = a_ids.to_numpy(), b_ids.to_numpy()
    if not good.all():
        a_kept, b_kept = good[a_parents], good[b_parents]
        a_ids, a_parents, a_lengths = a_ids[a_kept], a_parents[a_kept], a_lengths[a_kept]
        b_ids, b_parents, b_lengths = b_ids[b_kept], b_parents[b_kept], b_lengths[b_kept]
        sizes = np.where(good, sizes, 0)

    a_ends, b_ends = _segmented(a_lengths, a_parents, sizes), _segmented(b_lengths, b_parents, sizes)
    a_end, b_end = _common_ends(a_parents, a_ends, b_parents, b_ends)
    starts = np.cumsum(sizes) - sizes
    a_last, b_last = a_ends + starts[a_parents] - 1, b_ends + starts[b_parents] - 1
    # tokens of B that end before a byte: the number of the one that holds it
    ended = np.zeros(int(sizes.sum()) + 1, np.int32)
    ended[b_last + 1] = 1
    with_a = b_ids[np.cumsum(ended)[a_last]]
    ended[:] = 0
    ended[a_last + 1] = 1
    alone = np.ones(len(b_ids), bool)
    alone[b_end] = False
    with_b = a_ids[np.cumsum(ended)[b_last[alone]]]
    # a link ends where its first token ends: one for each token of A, one for each of B that ends within one of A
    links = np.concatenate([(a_ids.astype(np.int64) << 32) | with_a, (with_b.astype(np.int64) << 32) | b_ids[alone]])
    parents = np.concatenate([a_parents, b_parents[alone]])

    n_a, n_b = np.bincount(a_parents, minlength=rows), np.bincount(b_parents, minlength=rows)
    n_groups = np.bincount(a_parents[a_end], minlength=rows)
    counts = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}
    texts_of_groups = _written(a_ids, b_ids, a_end, b_end, a_parents, b_parents, rows)
    return counts, texts_of_groups, parents, links


# --- blocks ---------------------------------------------------------------------------------------------


class _Block:
    """Documents whose links share a list of pairs."""

    def __init__(self):
        self.bytes, self.ids, self.tables, self.links = 0, [], [], []

    def add(self, doc_ids: pa.Array, texts: list[str | None], pair: Pair) -> None:
        counts, groups, parents, links = align(texts, pair)
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        self.tables.append(pa.table({**counts, "groups_sha256": pa.array(digests, pa.string())}))
        # links of a document and pair, counted
        met = pa.table({"doc": parents.astype(np.int32), "pair": links}).group_by(["doc", "pair"], use_threads=False)
        met = met.aggregate([([], "count_all")])
        first = sum(len(i) for i in self.ids)
        docs = met["doc"].to_numpy() + np.int32(first)
        self.links.append((docs, met["pair"].combine_chunks(), met["count_all"].to_numpy().astype(np.int32)))
        self.ids.append(doc_ids)

    def write(self, folder: str) -> pa.RecordBatch:
        """Writes the documents and their links; returns the list of pairs, each with its number of documents."""
        docs = np.concatenate([d for d, _, _ in self.links])
        pairs = pa.chunked_array([p for _, p, _ in self.links], pa.int64()).combine_chunks().dictionary_encode()
        times = np.concatenate([t for _, _, t in self.links])
        place = pairs.indices.to_numpy()
        order = np.argsort(docs, kind="stable")
        ids = pa.chunked_array(self.ids).combine_chunks()
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.bincount(docs, minlength=len(ids)), out=offsets[1:])
        table = pa.concat_tables(self.tables)
        for name, values in (("pairs", place), ("times", times)):
            table = table.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order])))
        number = uuid.uuid4().int >> 65
        table = table.cast(_FILE).add_column(0, "doc_id", ids)
        store, path = open_store(_path(folder, number))
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as sink:
            with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
        listed = pairs.dictionary.to_numpy()
        held = np.bincount(place, minlength=len(listed))
        # a block without links keeps a row, so that its documents are not lost
        rows = max(1, len(listed))
        columns = [listed >> 32, listed & 0xFFFFFFFF, held] if len(listed) else [[None], [None], [None]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, number, np.int64)), pa.array(np.arange(rows, dtype=np.int32))]
            + [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64()))],
            names=["block", "place", "a", "b", "docs"],
        )


def _path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/links-{number:016x}.arrow"


def write_links(docs: DataFrame, folder: str, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Aligns ``docs`` and writes their links below ``folder``; returns ``block, place, a, b, docs``.

    ``docs`` is how many documents of the block hold the pair ``a, b``, ``place`` its place in the block's list. A file
    counts once its block is in this table, which Spark commits.
    """
    chosen = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = _pair(byte_level, pieces), _Block()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = size = 0
            for row, n in enumerate(sizes.tolist(), 1):
                size += n
                if size < CHUNK and row < batch.num_rows:
                    continue
                block.add(batch.column(0).slice(start, row - start), batch.column(1).slice(start, row - start).to_pylist(), pair)
                block.bytes += size
                start, size = row, 0
                if block.bytes >= BLOCK:
                    yield block.write(folder)
                    block = _Block()
        if block.ids:
            yield block.write(folder)

    return materialize(chosen.mapInArrow(run, "block long, place int, a int, b int, docs long"), "pairs")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, docs, best``: how many documents hold a pair, and whether no pair of the same ``a`` is in more.

    The rows of one ``a`` are at most as many as there are pieces.
    """
    counted = pairs.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return counted.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def _scored(table: pa.Table, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """A file's documents with the sum of their links' counts, and the number of best links."""
    pairs = table["pairs"].combine_chunks()
    place, times = pairs.flatten().to_numpy(), table["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy())])

    def sums(values):
        running = np.concatenate([[0], np.cumsum(values)])
        return running[ends[1:]] - running[ends[:-1]]

    found = table.drop_columns(["pairs", "times"])
    found = found.append_column("n_best", pa.array(sums(times * best[place])))
    found = found.append_column("count_sum", pa.array(sums(times * docs[place])))
    return found.combine_chunks().to_batches()[0]


def alignments(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    * Null and empty texts, and such whose tokens' bytes are not those of the text behind a space, have no tokens: zeros,
      and an empty digest.
    * Rows that repeat are documents of their own, and count as such. Other columns are not read. An empty table gives
      an empty result.
    * A task holds a block's links, those of one text at least; a text's own need some 100 bytes for each of its.
    """
    folder = output_folder(docs.sparkSession, "links")
    pairs = write_links(docs, folder, byte_level, pieces, text, doc_id)
    counts = pair_counts(pairs).select("a", "b", F.col("docs").alias("all_docs"), "best")
    valued = pairs.join(counts, ["a", "b"], "left").select("block", "place", "all_docs", "best")
    by_block = valued.repartition("block").sortWithinPartitions("block", "place")

    def scored(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        store, path = open_store(_path(folder, block))
        with store.open_input_file(path) as source:
            table = pa.ipc.open_file(source).read_all()
        columns = pa.Table.from_batches(held)
        # null in the one row of a block without links
        docs, best = pc.fill_null(columns["all_docs"], 0), pc.fill_null(columns["best"], False)
        return _scored(table, docs.to_numpy(), best.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if block is not None and numbers[start] != block:
                    yield scored(block, held)
                    held = []
                block = int(numbers[start])
                held.append(batch.slice(start, end - start))
        if block is not None:
            yield scored(block, held)

    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    schema = ", ".join(f"{n} {'string' if 'sha' in n else kind if n == 'doc_id' else 'long'}" for n in names)
    return by_block.mapInArrow(run, schema)
