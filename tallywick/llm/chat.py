"""Chat formatting at the level of tokens.

Every segment of a turn (role, line break, text) is encoded on its own, reserved ids are put between them, and the
loss mask comes from prefix sums over the marks where assistant texts begin and end. Control strings in roles and
texts are escaped: ``<``, any number of ``\\``, ``|`` gets one more ``\\``, so no text can hold a control string and
removing one ``\\`` restores it. A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``.

A conversation's rows are sorted by turn and pass through a task one after the other; ids leave in pieces of bounded
length, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywick.llm.bpe import codec

START, END = "<|im_start|>", "<|im_end|>"
PIECE = 8_192
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def reserved(path: str) -> tuple[int, int]:
    """The ids of turn start and turn end: the first two the vocabulary leaves free."""
    return codec(path).size, codec(path).size + 1


def encode_turn(role: str | None, text: str | None, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a turn; the mask covers an assistant's text and nothing else."""
    coder, (start, end) = codec(path), reserved(path)
    line = coder.encode("\n", special=False)
    name = coder.encode(_escape_role(role or ""), special=False)
    body = coder.encode(escape(text or ""), special=False)
    ids = np.concatenate([[start], name, line, body, [end], line]).astype(np.int32)
    marks = np.zeros(len(ids) + 1, dtype=np.int8)
    if role == "assistant":
        first = 1 + len(name) + len(line)
        marks[first] += 1
        marks[first + len(body)] -= 1
    return ids, np.cumsum(marks[:-1]) > 0


def format_conversations(
    turns: DataFrame,
    path: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """``conv_id, piece, ids, mask``: each conversation's tokens, cut into pieces of at most ``piece``.

    Rows are ordered by turn, then role and text; repeated rows are repeated turns. Null roles and texts are empty, a
    null conversation is one of its own. Other columns are not read; an empty table gives an empty result.
    """
    chosen = turns.select(
        turns[conv_id].alias("conv_id"), turns[turn].alias("turn"), turns[role].cast("string").alias("role"), turns[text].cast("string").alias("text")
    )
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = chosen.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held_ids, held_mask = [], []
        now, number, held = None, 0, 0
        conv_type = None

        def cut(everything: bool) -> None:
            nonlocal held_ids, held_mask, held, number
            ids, mask = np.concatenate(held_ids), np.concatenate(held_mask)
            stop = len(ids) if everything else len(ids) - len(ids) % piece
            for at in range(0, stop, piece):
                out.append((now, number, ids[at : min(at + piece, stop)], mask[at : min(at + piece, stop)]))
                number += 1
            held_ids, held_mask, held = [ids[stop:]], [mask[stop:]], len(ids) - stop

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            arrays = [
                pa.array(columns[0], conv_type),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.list_(pa.int32())),
                pa.array(columns[3], pa.list_(pa.bool_())),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "piece", "ids", "mask"])

        begun = False
        for batch in batches:
            conv_type = batch.column(0).type
            convs, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv, who, said in zip(convs, roles, texts):
                if not begun or conv != now:
                    if begun:
                        cut(everything=True)
                    now, number, held, held_ids, held_mask, begun = conv, 0, 0, [], [], True
                ids, mask = encode_turn(who, said, path)
                held_ids.append(ids)
                held_mask.append(mask)
                held += len(ids)
                if held >= piece:
                    cut(everything=False)
                if len(out) >= 512:
                    yield batch_of()
        if begun:
            cut(everything=True)
        if out:
            yield batch_of()

    return ordered.mapInArrow(run, f"conv_id {kind}, piece long, ids array<int>, mask array<boolean>")


class _Reader:
    """Follows a conversation's tokens and sums up its turns."""

    def __init__(self, path: str):
        self.coder, (self.start, self.end) = codec(path), reserved(path)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.ids: list[np.ndarray] = []
        self.masks: list[np.ndarray] = []

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        at = 0
        for stop in np.flatnonzero(ids == self.end) + 1:
            self.ids.append(ids[at:stop])
            self.masks.append(mask[at:stop])
            self._turn()
            at = stop
        self.ids.append(ids[at:])
        self.masks.append(mask[at:])

    def _turn(self) -> None:
        ids, mask = np.concatenate(self.ids), np.concatenate(self.masks)
        self.ids, self.masks = [], []
        begin = int(np.flatnonzero(ids == self.start)[0])
        between = self.coder.decode(ids[:begin])
        body = self.coder.decode(ids[begin + 1 : -1])
        role, _, text = body.partition("\n")
        self.formatted_chars += len(between) + len(START) + len(body) + len(END)
        self.turns.update(f"{_unescape_role(role)}\n{unescape(text)}\n".encode())
        self.n_turns += 1
        if mask.any():
            said = unescape(self.coder.decode(ids[mask]))
            self.loss.update(said.encode())
            self.loss_chars += len(said)

    def result(self) -> tuple:
        self.formatted_chars += len(self.coder.decode(np.concatenate(self.ids))) if self.ids else 0
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_conversations(formatted: DataFrame, path: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` read from formatted pieces."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, out, conv_type = None, None, [], None

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [conv_type, *arrow])], names=names)

        for batch in batches:
            conv_type = batch.column(0).type
            convs = batch.column(0).to_pylist()
            for i, conv in enumerate(convs):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append((now, *reader.result()))
                    now, reader = conv, _Reader(path)
                reader.feed(
                    batch.column(2)[i].values.to_numpy(zero_copy_only=False), batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                )
            if len(out) >= 4_096:
                yield batch_of()
        if reader is not None:
            out.append((now, *reader.result()))
        if out:
            yield batch_of()

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)
