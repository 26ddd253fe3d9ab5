"""Survey files in the binary format of statistics packages (``.sav``): typed variables, value labels, packed cases.

A file is a dictionary of variables followed by cases of equal numbers of 8-byte elements. Packed cases are groups of
eight one-byte codes and the elements that no code can stand for; a group's place depends on all groups before it. One
task per file therefore runs over the codes alone and notes, every so many cases, where a group begins; then each range
of cases is a task of its own, which decodes its groups with array operations and turns labelled codes into labels.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallywick.sources.ranges import NewFile, list_files, open_range, open_uri

#: Cases decoded by one task.
SPLIT_CASES = 100_000
# fixed values of the format: records of the dictionary, and codes of packed cases
_VARIABLE, _LABELS, _LABELLED, _NOTES, _EXTENSION, _END = 2, 3, 4, 6, 7, 999
_LONG_NAMES, _ENCODING = 13, 20
_SKIP, _LAST, _STOP, _LITERAL, _BLANKS, _MISSING = 0, 251, 252, 253, 254, 255
_MISSING_NUMBER = -np.finfo(np.float64).max
_BIAS = 100
_CHUNK = 4 << 20


@dataclass
class Variable:
    """A column: its name, width in bytes (0: a number), and the labels of its values."""

    name: str
    width: int
    at: int = 0
    labels: dict = field(default_factory=dict)

    @property
    def elements(self) -> int:
        return max(1, -(-self.width // 8))


@dataclass
class Dictionary:
    """What stands before the cases; ``start`` is their first byte, ``cases`` their number or -1."""

    variables: list[Variable]
    packed: bool
    cases: int
    bias: float
    start: int
    order: str
    encoding: str = "utf-8"

    @property
    def elements(self) -> int:
        return sum(v.elements for v in self.variables)

    def schema(self, labels: bool = True) -> StructType:
        text = [bool(v.width or (labels and v.labels)) for v in self.variables]
        return StructType([StructField(v.name, StringType() if t else DoubleType()) for v, t in zip(self.variables, text)])


class _Bytes:
    """A file read forward, number by number."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.order = source, "<"

    def take(self, n: int) -> bytes:
        data = self.source.read(n)
        if len(data) < n:
            raise ValueError("the file ends within its dictionary")
        return data

    def ints(self, n: int = 1) -> tuple[int, ...]:
        return struct.unpack(f"{self.order}{n}i", self.take(4 * n))


def read_dictionary(source: pa.NativeFile) -> Dictionary:
    """The dictionary of a file that is open at its beginning."""
    data = _Bytes(source)
    if data.take(4) not in (b"$FL2",):
        raise ValueError("not a survey file, or packed as a whole")
    data.take(60)
    layout = data.take(4)
    data.order = "<" if struct.unpack("<i", layout)[0] in (2, 3) else ">"
    _, packed, _, cases = data.ints(4)
    (bias,) = struct.unpack(f"{data.order}d", data.take(8))
    data.take(84)
    variables: list[Variable] = []
    element_of: list[Variable | None] = []
    renamed: dict[str, str] = {}
    found = Dictionary(variables, packed == 1, cases, bias, 0, data.order)
    raw_labels: list[tuple[Variable, dict[bytes, bytes]]] = []
    pending: dict[bytes, bytes] = {}
    while True:
        (kind,) = data.ints()
        if kind == _VARIABLE:
            width, has_label, missing, _, _ = data.ints(5)
            name = data.take(8).decode("latin-1").rstrip()
            if has_label:
                (n,) = data.ints()
                data.take(-(-n // 4) * 4)
            data.take(8 * abs(missing))
            if width >= 0:
                variables.append(Variable(name, width, len(element_of)))
            element_of.append(variables[-1] if width >= 0 else None)
        elif kind == _LABELS:
            pending = {}
            for _ in range(data.ints()[0]):
                value, n = data.take(8), data.take(1)[0]
                pending[value] = data.take(-(-(n + 1) // 8) * 8 - 1)[:n]
        elif kind == _LABELLED:
            (n,) = data.ints()
            raw_labels += [(element_of[i - 1], pending) for i in data.ints(n)]
        elif kind == _NOTES:
            data.take(80 * data.ints()[0])
        elif kind == _EXTENSION:
            subtype, size, count = data.ints(3)
            content = data.take(size * count)
            if subtype == _LONG_NAMES:
                renamed = dict(pair.split("=", 1) for pair in content.decode("utf-8", "replace").split("\t") if "=" in pair)
            elif subtype == _ENCODING:
                found.encoding = content.decode("ascii").strip().lower()
        elif kind == _END:
            data.ints()
            break
        else:
            raise ValueError(f"unknown record {kind} in the dictionary")
    for variable, labels in raw_labels:
        for value, label in labels.items():
            key = value.rstrip(b" ").decode(found.encoding) if variable.width else struct.unpack(f"{data.order}d", value)[0]
            variable.labels[key] = label.decode(found.encoding)
    for variable in variables:
        variable.name = renamed.get(variable.name, variable.name)
    found.start = source.tell()
    return found


# --- reading ----------------------------------------------------------------------------------------------


def survey_schema(spark: SparkSession, path: str, labels: bool = True) -> StructType:
    """The columns of the files below ``path``, from the dictionary of the first by name."""
    first = list_files(spark, path, ".sav").agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        raise ValueError(f"no survey file in {path}")
    with open_range(first) as source:
        return read_dictionary(source).schema(labels)


def _borders(source: pa.NativeFile, found: Dictionary, every: int) -> Iterator[tuple[int, int, int]]:
    """``first case, byte of a group, elements before that group`` about every so many cases, then the end."""
    elements, size = found.elements, source.size()
    if not found.packed:
        cases = (size - found.start) // (8 * elements)
        for case in range(0, cases, every):
            yield case, found.start + case * elements * 8, case * elements
        yield cases, size, cases * elements
        return
    at, seen, noted = found.start, 0, -1
    chunk, base = b"", found.start
    while True:
        case = -(-seen // elements)
        if case >= noted + every or noted < 0:
            noted = case
            yield case, at, seen
        place = at - base
        if place + 8 > len(chunk):
            source.seek(at)
            chunk, base, place = source.read(_CHUNK), at, 0
            if not chunk:
                break
        codes = chunk[place : place + 8]
        stop = codes.find(_STOP)
        if stop >= 0:
            codes = codes[:stop]
        seen += len(codes) - codes.count(_SKIP)
        at += 8 + 8 * codes.count(_LITERAL)
        if stop >= 0:
            break
    yield seen // elements, at, seen


def _elements(data: bytes, wanted: int, bias: float, order: str) -> np.ndarray:
    """The 8-byte elements that the groups at the start of ``data`` stand for, ``wanted`` of them at most."""
    starts, at, seen = [], 0, 0
    while seen < wanted and at < len(data):
        codes = data[at : at + 8]
        starts.append(at)
        seen += 8 - codes.count(_SKIP)
        at += 8 + 8 * codes.count(_LITERAL)
    raw = np.frombuffer(data, np.uint8)
    starts = np.array(starts, np.int64)
    places = starts[:, None] + np.arange(8)
    codes = np.where(places < len(raw), raw[np.minimum(places, len(raw) - 1)], _STOP)
    literal = codes == _LITERAL
    # a group's literals stand behind it, one after the other
    literal_at = (starts[:, None] + 8 + 8 * (np.cumsum(literal, axis=1) - 1))[literal]
    values = np.empty(codes.shape, f"{order}f8")
    values[...] = codes - bias
    values[codes == _MISSING] = _MISSING_NUMBER
    cells = values.view(np.uint8).reshape(*codes.shape, 8)
    cells[codes == _BLANKS] = ord(" ")
    cells[literal] = raw[literal_at[:, None] + np.arange(8)]
    stop = np.cumsum((codes == _STOP).ravel()) > 0
    kept = (codes.ravel() != _SKIP) & ~stop
    return cells.reshape(-1, 8)[kept][:wanted]


def _columns(cells: np.ndarray, found: Dictionary, labels: bool) -> list[pa.Array]:
    """The columns of whole cases, which are rows of elements."""
    cases, made = len(cells), []
    for v in found.variables:
        part = np.ascontiguousarray(cells[:, v.at : v.at + v.elements]).reshape(cases, v.elements * 8)
        if v.width:
            part = np.ascontiguousarray(part[:, : v.width])
            offsets = np.arange(cases + 1, dtype=np.int64) * v.width
            fixed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), cases, [None, pa.py_buffer(offsets), pa.py_buffer(part)])
            if found.encoding.replace("-", "") not in ("utf8", "ascii", "usascii"):
                fixed = pa.array([b.decode(found.encoding).encode() for b in fixed.to_pylist()], pa.large_binary())
            text = pc.utf8_rtrim(fixed.cast(pa.large_string()), " ").cast(pa.string())
            if labels and v.labels:
                text = _labelled(text, v.labels, text)
            made.append(pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text))
            continue
        numbers = part.view(f"{found.order}f8")[:, 0].astype(np.float64)
        values = pa.array(numbers, mask=numbers == _MISSING_NUMBER)
        if labels and v.labels:
            whole = pc.cast(values, pa.string())
            text = pc.if_else(pc.equal(values, pc.floor(values)), pc.cast(pc.cast(values, pa.int64(), safe=False), pa.string()), whole)
            values = _labelled(values, v.labels, text)
        made.append(values)
    return made


def _labelled(values: pa.Array, labels: Mapping, text: pa.Array) -> pa.Array:
    """Labels of values; a value without one as text."""
    known = pa.array(list(labels), values.type)
    at = pc.index_in(values, known, skip_nulls=True)
    return pc.coalesce(pa.array(list(labels.values()), pa.string()).take(at), text.cast(pa.string()))


def read_survey(
    spark: SparkSession, path: str, schema: StructType | str | None = None, labels: bool = True, split: int = SPLIT_CASES
) -> DataFrame:
    """The cases of all ``.sav`` files below ``path``.

    Texts lose the blanks behind them; blank texts and missing numbers are null. With ``labels``, values that have one
    become it, as text; without, and for variables without labels, numbers are doubles. ``schema`` chooses columns by
    name and casts them, null where a value doesn't fit; without it the columns are those of the first file.

    Every file brings its own dictionary; a column that a file lacks is null in its rows. Texts wider than 255 bytes,
    which the format splits over several variables, stay split. Files packed as a whole can't be split and are refused.
    """
    full = survey_schema(spark, path, labels) if schema is None else schema
    if isinstance(full, str):
        full = StructType.fromDDL(full)
    names = full.names
    files = list_files(spark, path, ".sav")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_range(uri) as source:
                    found = read_dictionary(source)
                    borders = list(_borders(source, found, split))
                rows = [(uri, a, b, c, nxt[0], nxt[1]) for (a, b, c), nxt in zip(borders, borders[1:]) if nxt[0] > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_RANGE)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _texts(_decoded(row, labels), names)

    # a file's codes are one task's work; its ranges are then dealt out
    ranges = files.repartition("path").mapInArrow(index, "path string, " + ", ".join(f"{n} long" for n in _RANGE[1:]))
    texts = StructType([StructField(n, StringType()) for n in names])
    cases = ranges.repartition("path", "first").mapInArrow(parse, texts)
    return cases.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in full.fields])


_RANGE = ["path", "first", "byte", "before", "last", "next"]


def _decoded(row: dict, labels: bool) -> pa.Table:
    """The cases of one range."""
    with open_range(row["path"]) as source:
        found = read_dictionary(source)
        n, width = row["last"] - row["first"], found.elements
        if found.packed:
            # the last case may end in the group after the range: as many bytes as one case can take
            source.seek(row["byte"])
            data = source.read(row["next"] - row["byte"] + 16 * (width + 8))
            skip = row["first"] * width - row["before"]
            cells = _elements(data, skip + n * width, found.bias, found.order)[skip:]
        else:
            source.seek(row["byte"])
            cells = np.frombuffer(source.read(n * width * 8), np.uint8).reshape(-1, 8)
    cells = cells[: n * width].reshape(n, width, 8)
    return pa.table(dict(zip([v.name for v in found.variables], _columns(cells, found, labels))))


def _texts(table: pa.Table, names: Sequence[str]) -> pa.RecordBatch:
    """The named columns as text, whole numbers without a point."""
    columns = []
    for name in names:
        if name not in table.column_names:
            columns.append(pa.nulls(len(table), pa.string()))
            continue
        values = table[name].combine_chunks()
        if pa.types.is_floating(values.type):
            whole = pc.and_(pc.equal(values, pc.floor(values)), pc.less(pc.abs(values), 2**53))
            exact = pc.cast(pc.cast(pc.if_else(whole, values, 0), pa.int64()), pa.string())
            values = pc.if_else(whole, exact, pc.cast(values, pa.string()))
        columns.append(values.cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=list(names))


# --- writing ----------------------------------------------------------------------------------------------


def write_survey(df: DataFrame, path: str, labels: Mapping[str, Sequence[str]] | None = None, packed: bool = True) -> None:
    """Writes ``df`` as survey files, one per task, in a folder that must not exist.

    Numbers become numeric variables. Columns named in ``labels`` become numeric codes from 1 on with these labels; any
    other value of such a column is an error. Other columns are texts as wide as their longest value, 255 bytes at most.
    """
    labels = dict(labels or {})
    numeric = {f.name for f in df.schema.fields if not isinstance(f.dataType, StringType)}
    texts = [c for c in df.columns if c not in labels and c not in numeric]
    widths = {}
    if texts:
        longest = df.agg(*[F.coalesce(F.max(F.octet_length(F.col(f"`{c}`"))), F.lit(1)).alias(c) for c in texts]).first()
        widths = {c: max(1, longest[c]) for c in texts}
    if any(w > 255 for w in widths.values()):
        raise ValueError(f"texts of more than 255 bytes: {[c for c, w in widths.items() if w > 255]}")
    variables = [Variable(c, widths.get(c, 0), 0, dict(enumerate(labels.get(c, ()), 1))) for c in df.columns]
    plain = df.select(*[F.col(f"`{c}`").cast("double" if c in numeric else "string").alias(c) for c in df.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, cases = None, 0
        packer = _Packer(packed)
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                name = f"part-{uuid.uuid4().hex}.sav"
                file = NewFile(path, name)
                file.write(_header(variables, packed))
            file.write(packer.add(_cells(batch, variables)))
            cases += batch.num_rows
        if file is not None:
            file.write(packer.finish())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([cases])], names=["name", "cases"])

    # a task that is repeated leaves a second file, so the files of this run's tasks are told by their rows
    rows = plain.mapInArrow(run, "name string, cases long").collect()
    _drop_others(path, {r["name"] for r in rows})


def _drop_others(path: str, names: set[str]) -> None:
    """Removes files of attempts that Spark did not count."""
    store, base = open_uri(path)
    store.create_dir(base, recursive=True)
    for info in store.get_file_info(pafs.FileSelector(base)):
        if info.base_name.endswith(".sav") and info.base_name not in names:
            store.delete_file(info.path)


def _header(variables: list[Variable], packed: bool) -> bytes:
    """The dictionary; the number of cases is left open, as it is written first."""
    width = sum(v.elements for v in variables)
    parts = [
        b"$FL2" + b"@(#) survey file".ljust(60), struct.pack("<5id", 2, width, int(packed), 0, -1, _BIAS),
        b"01 Jan 00" + b"00:00:00" + b" " * 64 + b"\0" * 3,
    ]
    element, longs = 1, []
    for number, v in enumerate(variables, 1):
        short = f"V{number:07d}"
        longs.append(f"{short}={v.name}")
        form = (1 << 16 | min(v.width, 255) << 8) if v.width else (5 << 16 | 8 << 8 | 2)
        parts.append(struct.pack("<6i", _VARIABLE, v.width, 0, 0, form, form) + short.encode())
        parts += [struct.pack("<6i", _VARIABLE, -1, 0, 0, form, form) + b" " * 8] * (v.elements - 1)
    for v in variables:
        if v.labels:
            parts.append(struct.pack("<2i", _LABELS, len(v.labels)))
            for value, label in v.labels.items():
                text = label.encode()[:255]
                parts.append(struct.pack("<d", value) + bytes([len(text)]) + text.ljust(-(-(len(text) + 1) // 8) * 8 - 1))
            parts.append(struct.pack("<3i", _LABELLED, 1, element))
        element += v.elements
    for subtype, text in ((_LONG_NAMES, "\t".join(longs)), (_ENCODING, "UTF-8")):
        data = text.encode()
        parts.append(struct.pack("<4i", _EXTENSION, subtype, 1, len(data)) + data)
    parts.append(struct.pack("<2i", _END, 0))
    return b"".join(parts)


def _cells(batch: pa.RecordBatch, variables: list[Variable]) -> np.ndarray:
    """The cases' elements: an array of cases, elements and 8 bytes."""
    cases, made = batch.num_rows, []
    for column, v in zip(batch.columns, variables):
        if v.width:
            joined = b"".join((s or "").encode().ljust(8 * v.elements) for s in column.to_pylist())
            made.append(np.frombuffer(joined, np.uint8).reshape(cases, v.elements, 8))
            continue
        if v.labels:
            at = pc.index_in(column, pa.array(list(v.labels.values()), pa.string()), skip_nulls=True)
            unknown = pc.and_(pc.is_null(at), pc.is_valid(column))
            if pc.any(unknown).as_py():
                raise ValueError(f"{v.name} has values without a label")
            column = pc.add(pc.cast(at, pa.float64()), 1.0)
        numbers = pc.fill_null(pc.cast(column, pa.float64()), float(_MISSING_NUMBER)).to_numpy(zero_copy_only=False)
        made.append(np.ascontiguousarray(numbers, "<f8").view(np.uint8).reshape(cases, 1, 8))
    return np.concatenate(made, axis=1)


class _Packer:
    """Turns elements into groups of codes and literals; what doesn't fill a group waits for more."""

    def __init__(self, packed: bool):
        self.packed, self.held = packed, np.zeros((0, 8), np.uint8)

    def add(self, cells: np.ndarray) -> bytes:
        cells = cells.reshape(-1, 8)
        if not self.packed:
            return cells.tobytes()
        cells = np.concatenate([self.held, cells])
        whole = len(cells) // 8 * 8
        self.held = cells[whole:]
        return self._groups(cells[:whole])

    def finish(self) -> bytes:
        if not self.packed:
            return b""
        n = len(self.held)
        codes, literals = self._codes(self.held)
        codes = np.concatenate([codes, [_STOP], np.zeros(8, np.uint8)])[: 8 if n < 8 else 16].astype(np.uint8)
        return codes.tobytes() + self.held[literals].tobytes()

    @staticmethod
    def _codes(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.ascontiguousarray(cells).view("<f8")[:, 0]
        with np.errstate(invalid="ignore"):
            small = (numbers >= 1 - _BIAS) & (numbers <= _LAST - _BIAS) & (numbers == np.floor(numbers))
            # minus zero is no zero of the codes
            small &= ~((numbers == 0) & np.signbit(numbers))
            codes = np.where(small, np.where(small, numbers, 0) + _BIAS, _LITERAL).astype(np.uint8)
        codes[(cells == ord(" ")).all(axis=1)] = _BLANKS
        codes[numbers == _MISSING_NUMBER] = _MISSING
        return codes, codes == _LITERAL

    def _groups(self, cells: np.ndarray) -> bytes:
        codes, literal = self._codes(cells)
        groups = len(codes) // 8
        literals = literal.reshape(groups, 8).sum(axis=1)
        starts = np.cumsum(8 + 8 * literals) - (8 + 8 * literals)
        out = np.empty(int((8 + 8 * literals).sum()), np.uint8)
        out[(starts[:, None] + np.arange(8)).ravel()] = codes
        rank = (np.cumsum(literal.reshape(groups, 8), axis=1) - 1).ravel()[literal]
        at = np.repeat(starts, 8)[literal] + 8 + 8 * rank
        out[(at[:, None] + np.arange(8)).ravel()] = cells[literal].ravel()
        return out.tobytes()
