"""WARC archives of pages, written from and read back as a chunked record table.

A record travels as rows of record and chunk number with at most ``CHUNK`` bytes of payload each, in order. Writing
appends chunk after chunk to the record's compressed member; reading parses the archive as it is decompressed and
emits chunk rows, each with the SHA-1 of the payload so far. Neither side holds a whole record.

Of equal payloads of at least ``REVISIT_BYTES`` bytes one record is the response, the others are revisits that name it
and carry its HTTP header and digest, but no payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallywick.llm.storage import attempt_file, materialize, open_store, output_folder

CHUNK = 1 << 16
REVISIT_BYTES = 1_000
#: Pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
# bytes of chunks sent on at once
_FLUSH = 1 << 22
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RECORDS = [
    ("page_id", "string", pa.string()),
    ("chunk_no", "long", pa.int64()),
    ("chunk", "binary", pa.binary()),
    ("digest_so_far", "string", pa.string()),
    ("last", "boolean", pa.bool_()),
    ("record_type", "string", pa.string()),
    ("uri", "string", pa.string()),
    ("payload_digest", "string", pa.string()),
    ("payload_bytes", "long", pa.int64()),
    ("refers_to", "string", pa.string()),
]


# --- records --------------------------------------------------------------------------------------------


def chunk_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", size: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages``, a record's chunks one after the other in one task.

    * A null page is empty; an empty payload is one empty chunk. Revisits have one chunk, without bytes.
    * The response of equal payloads is the one with the largest id; null ids lose to others. Rows that repeat an id
      and a payload are alike: all responses or all revisits. Other columns are not read.
    """
    payload = F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # counts of copies form before anything moves; a page only meets its group's largest id
    copies = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    decided = rows.join(copies, ["payload_digest", "payload_bytes"], "left")
    revisit: Column = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    decided = decided.withColumn("revisit", revisit)
    chunks = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / size)).cast("int"))
    return decided.withColumn("chunks", chunks).select(
        F.col("page_id").cast("string").alias("page_id"),
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        "uri",
        "payload_digest",
        "payload_bytes",
        F.when(F.col("revisit"), F.col("first_id").cast("string")).alias("refers_to"),
        "chunks",
        "payload",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"),
    ).select(
        "page_id",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size))).alias("chunk"),
        (F.col("chunk_no") + 1 == F.col("chunks")).alias("last"),
        "record_type",
        "uri",
        "payload_digest",
        "payload_bytes",
        "refers_to",
    )


def _record_id(page_id: str | None, digest: str) -> str:
    """The page's id, its reserved characters escaped, and the payload's digest; a null id is left out."""
    return f"<urn:page{'' if page_id is None else ':' + quote(page_id, safe='')}:{digest}>"


def _page_of(record_id: str) -> str | None:
    parts = record_id.split(":")
    return unquote(parts[2]) if len(parts) == 4 else None


def _headers(row: dict) -> bytes:
    """The record's own header and its HTTP header; a revisit's block is the latter alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_record_id(row['page_id'], row['payload_digest'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m.group()):02X}', row['uri'] or '')}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'], row['payload_digest'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


# --- writing --------------------------------------------------------------------------------------------


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes an archive per task below ``folder``, a compressed member per record; returns the committed manifest.

    The digest is taken while chunks pass and must agree with the record's header, else the task fails.
    """
    columns = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = attempt_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.gz")
        sink = member = digest = None
        records = 0
        for batch in batches:
            for row in (dict(zip(columns, values)) for values in zip(*(c.to_pylist() for c in batch.columns))):
                if sink is None:
                    store, place = open_store(path)
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(place, compression=None)  # members are compressed here
                if row["chunk_no"] == 0:
                    member, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    sink.write(member.compress(_headers(row)))
                if row["chunk"]:
                    digest.update(row["chunk"])
                    sink.write(member.compress(row["chunk"]))
                if row["last"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"payload of page {row['page_id']} doesn't have its digest")
                    sink.write(member.compress(_END) + member.flush())
                    records += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

    return materialize(chunks.mapInArrow(run, "path string, records long"), "manifest")


# --- reading --------------------------------------------------------------------------------------------


def _inflated(uri: str, size: int = CHUNK) -> Iterator[bytes]:
    """The archive's bytes, in parts of at most ``size``, over all its members."""
    store, path = open_store(uri)
    with store.open_input_file(path) as source:
        inflate, data = zlib.decompressobj(31), source.read(size)
        while data or not inflate.eof:
            out = inflate.decompress(data, size)
            if out:
                yield out
            if inflate.eof:
                data = inflate.unused_data or source.read(size)
                if not data:
                    return
                inflate = zlib.decompressobj(31)
                continue
            data = inflate.unconsumed_tail
            # a full part may have left more inside
            if not data and len(out) < size:
                data = source.read(size)
                if not data:
                    raise ValueError("archive ends within a member")


@dataclass
class _Source:
    """Reads lines and spans from a stream of parts."""

    parts: Iterator[bytes]
    held: bytearray = field(default_factory=bytearray)

    def _more(self) -> bool:
        for part in self.parts:
            if part:
                self.held += part
                return True
        return False

    def block(self) -> list[str] | None:
        """Lines up to an empty line; nothing at the end."""
        while (end := self.held.find(_END)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends within a record")
                return None
        lines = bytes(self.held[:end]).decode().split("\r\n")
        del self.held[: end + len(_END)]
        return lines

    def span(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("archive ends within a record")
        part = bytes(self.held[:most])
        del self.held[: len(part)]
        return part

    def skip(self, expected: bytes) -> None:
        while len(self.held) < len(expected):
            if not self._more():
                raise ValueError("archive ends within a record")
        if self.held[: len(expected)] != expected:
            raise ValueError("record is longer than its header says")
        del self.held[: len(expected)]


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse(parts: Iterator[bytes], size: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows (the columns of ``_RECORDS``) of the records in a stream of uncompressed bytes."""
    source = _Source(parts)
    while (lines := source.block()) is not None:
        header = _fields(lines)
        http_lines = source.block() or []
        http_bytes = sum(len(line.encode()) + 2 for line in http_lines) + 2
        left = int(header["content-length"]) - http_bytes
        kind, digest, number = header["warc-type"], hashlib.sha1(), 0
        refers = header.get("warc-refers-to")
        known = (
            kind,
            header["warc-target-uri"],
            header["warc-payload-digest"].partition(":")[2],
            int(_fields(http_lines)["content-length"]),
            None if refers is None else _page_of(refers),
        )
        page = _page_of(header["warc-record-id"])
        pending = b""
        while True:
            while left and len(pending) < size:
                part = source.span(min(left, size - len(pending)))
                pending, left = pending + part, left - len(part)
            digest.update(pending)
            yield (page, number, pending, digest.hexdigest(), left == 0, *known)
            if not left:
                break
            pending, number = b"", number + 1
        source.skip(_END)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunked record table read back from the archives of a manifest, one task per archive.

    ``digest_so_far`` is the SHA-1 of the payload up to the chunk's end, as read; ``payload_digest`` and
    ``payload_bytes`` are what the record says about the full payload.
    """
    names, kinds = [n for n, _, _ in _RECORDS], [k for _, _, k in _RECORDS]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in parse(_inflated(path)):
                    rows.append(row)
                    held += len(row[2]) + 200
                    if held >= _FLUSH:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in _RECORDS))


def archive_and_back(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record, read from new archives.

    Of a response, bytes and digest are those of the chunks read; of a revisit, those of the payload it stands for.
    """
    folder = output_folder(pages.sparkSession, "warc")
    kind = pages.schema[page_id].dataType
    back = read_archives(write_archives(chunk_rows(pages, page_id, url, html), folder)).where("last")
    response = F.col("record_type") == "response"
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.when(response, F.col("chunk_no") * CHUNK + F.octet_length("chunk")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
