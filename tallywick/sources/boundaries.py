"""Boundary files: polygons (``.shp``), their index (``.shx``) and attributes (``.dbf``), read in ranges of records.

The index says where each polygon lies, so one task per file cuts it into ranges of about equal size, and each range is
read by a task of its own: a part of the index, the polygons' bytes, and their rows of attributes. Rings become polygons
in well-known binary: rings that run clockwise are outlines, the others holes of the smallest outline around them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, IntegerType

from tallywick.sources.ranges import NewFile, list_files, open_range, open_uri

#: Bytes of polygons read by one task.
SPLIT_BYTES = 64 << 20
# fixed values of the formats
_MAGIC, _VERSION, _HEADER, _NONE = 9994, 1000, 100, 0
_POLYGONS = (5, 15, 25)
_POLYGON, _MULTI = 3, 6
_ROW_END, _DELETED = b"\r", b"*"
_RANGE = ["path", "first", "last"]


# --- one polygon --------------------------------------------------------------------------------------------


def turn(ring: np.ndarray) -> float:
    """Twice the area of a ring of points: positive if it runs against the clock."""
    x, y = ring[:, 0], ring[:, 1]
    # from the first point, so that far coordinates lose no digits
    x, y = x - x[:1], y - y[:1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def _inside(point: np.ndarray, ring: np.ndarray) -> bool:
    """Whether a point lies within a ring: a ray to the right crosses it an odd number of times."""
    x, y = point
    a, b = ring[:-1], ring[1:]
    crosses = (a[:, 1] > y) != (b[:, 1] > y)
    if not crosses.any():
        return False
    a, b = a[crosses], b[crosses]
    at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool((at > x).sum() % 2)


def polygons_of(rings: Sequence[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as polygons, each an outline and its holes; a hole without an outline becomes one."""
    turns = [turn(r) for r in rings]
    outlines = [i for i, t in enumerate(turns) if t <= 0]
    found = {i: [rings[i]] for i in outlines}
    for i, t in enumerate(turns):
        if t <= 0:
            continue
        around = [o for o in outlines if len(outlines) == 1 or _inside(rings[i][0], rings[o])]
        if around:
            found[min(around, key=lambda o: -turns[o])].append(rings[i])
        else:
            found[i] = [rings[i]]
    return [found[i] for i in sorted(found)]


def to_binary(polygons: Sequence[Sequence[np.ndarray]]) -> bytes:
    """Polygons in well-known binary: one as a polygon, several as a multipolygon."""

    def one(rings):
        parts = [struct.pack("<BII", 1, _POLYGON, len(rings))]
        for ring in rings:
            parts.append(struct.pack("<I", len(ring)) + np.ascontiguousarray(ring, "<f8").tobytes())
        return b"".join(parts)

    if len(polygons) == 1:
        return one(polygons[0])
    return struct.pack("<BII", 1, _MULTI, len(polygons)) + b"".join(map(one, polygons))


def from_binary(data: bytes) -> list[list[np.ndarray]]:
    """The polygons of well-known binary, in either byte order."""
    at = 0

    def take(form):
        nonlocal at
        values = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return values

    def polygon():
        nonlocal at
        order = "<" if take("B")[0] else ">"
        kind, n = take(f"{order}II")
        if kind == _MULTI:
            return [p for _ in range(n) for p in polygon()]
        if kind != _POLYGON:
            raise ValueError(f"no polygon but geometry {kind}")
        rings = []
        for _ in range(n):
            (points,) = take(f"{order}I")
            rings.append(np.frombuffer(data, f"{order}f8", 2 * points, at).reshape(points, 2))
            at += 16 * points
        return [rings]

    return polygon()


# --- reading --------------------------------------------------------------------------------------------------


def _beside(path: str, suffix: str) -> str:
    return path[: -len(".shx")] + suffix


def _index(path: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """Byte and length of the polygons from ``first`` to before ``last``, from the index."""
    with open_range(path) as source:
        source.seek(_HEADER + 8 * first)
        data = source.read(8 * (last - first)) if last is not None else source.read()
    # in words of two bytes; a record has a header of eight bytes before its content
    return np.frombuffer(data[: len(data) // 8 * 8], ">i4").reshape(-1, 2).astype(np.int64) * 2


def _ranges(path: str, size: int) -> Iterator[tuple[str, int, int]]:
    """Ranges of records of about ``size`` bytes, one record at least."""
    index = _index(path)
    if not len(index):
        return
    part = np.cumsum(index[:, 1] + 8) // max(1, size)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip([path] * len(cuts), cuts.tolist(), [*cuts[1:].tolist(), len(index)])


def _geometry(content: bytes) -> bytes | None:
    """A record's content in well-known binary; null for an empty shape."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == _NONE:
        return None
    if kind not in _POLYGONS:
        raise ValueError(f"shapes of kind {kind} are no polygons")
    parts, points = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", parts, 44)
    cells = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2)
    rings = [cells[a:b] for a, b in zip(starts, [*starts[1:], points])]
    return to_binary(polygons_of(rings))


def _attributes(path: str, first: int, last: int, names: Sequence[str]) -> tuple[dict[str, list[str | None]], list[bool]]:
    """The named columns of records ``first`` to before ``last`` as text, and whether a record is deleted."""
    with open_range(path) as source:
        _, start, width = struct.unpack_from("<IHH", source.read(12), 4)
        source.seek(32)
        fields, at = {}, 1
        while (entry := source.read(32))[:1] not in (_ROW_END, b""):
            name, size = entry[:11].split(b"\0")[0].decode("latin-1"), entry[16]
            fields[name.lower()] = (at, at + size)
            at += size
        source.seek(start + first * width)
        data = source.read((last - first) * width)
    rows = [data[i * width : (i + 1) * width] for i in range(last - first)]
    found = {}
    for name in names:
        a, b = fields.get(name.lower(), (0, 0))
        found[name] = [row[a:b].decode("utf-8", "replace").strip(" \0") or None for row in rows]
    return found, [row[:1] == _DELETED for row in rows]


def read_boundaries(
    spark: SparkSession, path: str, columns: Sequence[str] = ("GEOID", "STATEFP"), split: int = SPLIT_BYTES
) -> DataFrame:
    """The polygons of all files below ``path``: the named attributes as text, and ``geometry`` in well-known binary.

    Attributes that are empty or missing are null, and so is the geometry of an empty shape. Deleted rows are left
    out. Heights and measures of points are not read; shapes other than polygons are an error.
    """
    names = list(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for uri in batch.column(0).to_pylist() for r in _ranges(uri, split)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_RANGE)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                index = _index(uri, first, last)
                with open_range(_beside(uri, ".shp")) as source:
                    start, end = int(index[0, 0]), int(index[-1].sum()) + 8
                    source.seek(start)
                    data = source.read(end - start)
                values, deleted = _attributes(_beside(uri, ".dbf"), first, last, names)
                shapes = [_geometry(data[at - start + 8 : at - start + 8 + n]) for at, n in index.tolist()]
                arrays = [pa.array(values[n], pa.string()) for n in names] + [pa.array(shapes, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "geometry"]).filter(pa.array([not d for d in deleted]))

    files = list_files(spark, path, ".shx").repartition("path")
    ranges = files.mapInArrow(cut, "path string, first long, last long").repartition("path", "first")
    return ranges.mapInArrow(parse, ", ".join(f"`{n}` string" for n in names) + ", geometry binary")


def with_measures(boundaries: DataFrame) -> DataFrame:
    """Adds ``parts`` (polygons), ``vertices`` (points of all rings) and ``area`` (outlines less their holes).

    Null geometries have null measures.
    """
    at = boundaries.columns.index("geometry")
    schema = boundaries.select("*").schema.add("parts", IntegerType()).add("vertices", IntegerType()).add("area", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(at).to_pylist():
                if data is None:
                    rows.append((None, None, None))
                    continue
                polygons = from_binary(data)
                areas = [abs(turn(p[0])) - sum(abs(turn(hole)) for hole in p[1:]) for p in polygons]
                rows.append((len(polygons), sum(len(r) for p in polygons for r in p), sum(areas) / 2))
            parts, vertices, area = zip(*rows) if rows else ((), (), ())
            added = [pa.array(parts, pa.int32()), pa.array(vertices, pa.int32()), pa.array(area, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return boundaries.mapInArrow(run, schema)


# --- writing --------------------------------------------------------------------------------------------------


def write_boundaries(df: DataFrame, path: str, columns: Sequence[str] = ("GEOID", "STATEFP")) -> None:
    """Writes polygons as boundary files, three per task, in a folder that must not exist.

    ``df`` has the named texts and ``geometry``, polygons in well-known binary or null. Outlines are turned to run
    clockwise and holes against the clock. A file holds what its offsets can count, 8 GB; texts are as wide as the
    longest of their file, 254 bytes at most.
    """
    names = list(columns)
    plain = df.select(*[df[c].cast("string").alias(c) for c in names], df["geometry"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if batch.num_rows:
                writer = writer or _Writer(path, names)
                for *values, data in zip(*(c.to_pylist() for c in batch.columns)):
                    writer.add(values, data)
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([writer.close()])], names=["stem"])

    counted = {r["stem"] for r in plain.mapInArrow(run, "stem string").collect()}
    store, base = open_uri(path)
    store.create_dir(base, recursive=True)
    for info in store.get_file_info(pafs.FileSelector(base)):
        # files of attempts that Spark did not count
        if info.base_name.rsplit(".", 1)[0] not in counted:
            store.delete_file(info.path)


class _Writer:
    """The files of one task. Polygons leave as they come; headers, index and attributes are written at the end."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.stem = path, names, f"part-{uuid.uuid4().hex}"
        self.store, base = open_uri(path)
        self.store.create_dir(base, recursive=True)
        self.body = f"{base}/_{self.stem}.body"
        self.sink = self.store.open_output_stream(self.body)
        self.at, self.index, self.rows = _HEADER, [], []
        self.box = [np.inf, np.inf, -np.inf, -np.inf]

    def add(self, values: list[str | None], data: bytes | None) -> None:
        content = struct.pack("<i", _NONE) if data is None else self._content(from_binary(data))
        number = len(self.rows) + 1
        self.sink.write(struct.pack(">2i", number, len(content) // 2) + content)
        self.index.append((self.at // 2, len(content) // 2))
        self.at += 8 + len(content)
        if self.at >= 1 << 33:
            raise ValueError("more than 8 GB in a file; use more tasks")
        self.rows.append([(v or "").encode() for v in values])

    def _content(self, polygons: list[list[np.ndarray]]) -> bytes:
        rings = [r[::-1] if (turn(r) > 0) == (i == 0) else r for p in polygons for i, r in enumerate(p)]
        points = np.concatenate(rings) if rings else np.zeros((0, 2))
        low, high = (points.min(axis=0), points.max(axis=0)) if len(points) else (np.zeros(2), np.zeros(2))
        self.box = [min(self.box[0], low[0]), min(self.box[1], low[1]), max(self.box[2], high[0]), max(self.box[3], high[1])]
        starts = np.cumsum([0, *map(len, rings)])[:-1]
        head = struct.pack("<i4d2i", _POLYGONS[0], *low, *high, len(rings), len(points))
        return head + starts.astype("<i4").tobytes() + np.ascontiguousarray(points, "<f8").tobytes()

    def _head(self, size: int) -> bytes:
        box = self.box if np.isfinite(self.box).all() else [0.0] * 4
        return struct.pack(">7i", _MAGIC, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", _VERSION, _POLYGONS[0], *box, 0, 0, 0, 0)

    def close(self) -> str:
        self.sink.close()
        shapes = NewFile(self.path, f"{self.stem}.shp")
        shapes.write(self._head(self.at))
        with self.store.open_input_stream(self.body) as source:
            while part := source.read(8 << 20):
                shapes.write(part)
        shapes.close()
        self.store.delete_file(self.body)
        attributes = NewFile(self.path, f"{self.stem}.dbf")
        attributes.write(self._table())
        attributes.close()
        # the index last: readers go by it
        index = NewFile(self.path, f"{self.stem}.shx")
        index.write(self._head(_HEADER + 8 * len(self.index)) + np.array(self.index, ">i4").reshape(-1, 2).tobytes())
        index.close()
        return self.stem

    def _table(self) -> bytes:
        widths = [max(1, *(len(row[i]) for row in self.rows)) for i in range(len(self.names))]
        if max(widths, default=0) > 254:
            raise ValueError("texts of more than 254 bytes")
        fields = [n.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in zip(self.names, widths)]
        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(self.rows), 33 + 32 * len(fields), 1 + sum(widths))
        rows = [b" " + b"".join(v.ljust(w) for v, w in zip(row, widths)) for row in self.rows]
        return head + b"".join(fields) + _ROW_END + b"".join(rows) + b"\x1a"
