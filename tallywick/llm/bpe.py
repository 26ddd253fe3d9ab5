"""Byte-pair encoding and decoding.

The vocabulary is a public file; nothing is trained. A piece of text starts as a doubly linked list of its bytes'
symbols. A priority queue holds the merges of neighbours by rank and place; a merge whose symbols have changed since
it was queued is skipped. Decoding concatenates the vocabulary's strings.

Text is cut into pieces as byte-level vocabularies do. Most pieces recur, so a worker keeps the ids of pieces and
of the stretches between spaces it has met, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType

from tallywick.llm.storage import with_arrays

#: How byte-level vocabularies cut text; a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker remembers of either kind, and the longest text one may have.
REMEMBERED = 300_000
REMEMBERED_CHARS = 48

_PIECES = regex.compile(PIECES)
# any pair of white space, in a sense no narrower than the pieces' own; or the mark that cutting uses
_ODD = re.compile(r"\s\s|\x00")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in shown else next(rest) for b in range(256)]


class _Remembered(dict):
    """Results by key, made on first use and forgotten all at once beyond a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary = model["vocab"]
        symbols = byte_symbols()
        self.first = [vocabulary[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.strings = [b""] * self.size
        for token, i in {**vocabulary, **self.special}.items():
            known = all(c in byte_of for c in token)
            self.strings[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.pieces = _Remembered(self._piece)
        self.stretches = _Remembered(self._stretch)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece: merges in the order of rank, then place."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), dtype="<u4").tobytes()

    def _stretch(self, stretch: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(stretch)))

    def _plain(self, text: str) -> bytes:
        if _ODD.search(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        # where single white space stands between other characters, a piece ends before it, and after a line break
        marked = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")
        return b"".join(map(self.stretches.__getitem__, marked.split("\x00")))

    def encode_bytes(self, text: str, special: bool = True) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; ``special``: control strings have their ids."""
        if not special or self.cut is None or not self.cut.search(text):
            return self._plain(text)
        found, at = [], 0
        for match in self.cut.finditer(text):
            found.append(self._plain(text[at : match.start()]))
            found.append(np.array([self.special[match.group()]], dtype="<u4").tobytes())
            at = match.end()
        found.append(self._plain(text[at:]))
        return b"".join(found)

    def encode(self, text: str | None, special: bool = True) -> np.ndarray:
        """The ids of a text; null is the empty text."""
        return np.frombuffer(self.encode_bytes(text or "", special), dtype="<u4")

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a file, one per worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` (``array<int>``); null and empty texts have none."""
    return _mapped(docs, text, ids, ArrayType(IntegerType()), lambda t: codec(path).encode(t).astype(np.int32))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids``; null ids give the empty text."""
    return _mapped(docs, ids, text, StringType(), lambda i: codec(path).decode([] if i is None else i))


def _mapped(docs: DataFrame, given: str, name: str, kind: DataType, make) -> DataFrame:
    arrow = pa.string() if kind == StringType() else pa.list_(pa.int32())
    return with_arrays(docs, given, {name: kind}, lambda values: [pa.array([make(v) for v in values], arrow)])


def digests(text: str | None, path: str) -> tuple[int, str, str]:
    """Of one text: number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    coder = codec(path)
    ids = coder.encode(text).tolist()
    joined, decoded = hashlib.sha256(), hashlib.sha256()
    for start in range(0, len(ids), 1 << 18):
        part = ids[start : start + (1 << 18)]
        joined.update(b"," * (start > 0) + str(part)[1:-1].replace(" ", "").encode())
    decoded.update(coder.decode(ids).encode())
    return len(ids), joined.hexdigest(), decoded.hexdigest()


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, ids encoded and decoded in one pass.

    Null texts are empty, repeated rows each have a row, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digests(t, path) for t in batch.column(1).to_pylist()]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    chosen = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
