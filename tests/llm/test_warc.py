"""Archives: exact round trips, revisits, chunking."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallywick.llm import warc
from tallywick.llm.storage import open_store, output_folder

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "é" * 700 + "</p>"
RNG = random.Random(1)
LONG = "".join(RNG.choice("abc\r\nüxyz<>") for _ in range(300_000))
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/ x\r\nWARC-Type: no", "small"), (5, "u", "small"),
    (6, "u", None), (7, "u", ""), (8, "u", LONG), (9, "u", LONG), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "x" * 1000),
    (13, "u", "x" * 1000), (13, "u", "x" * 1000), (None, "u", BIG), (None, "u", "\r\n\r\n" * 300),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES).withColumn("record_type", F.lit("mine")).repartition(3)


def _expected():
    found = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 1000 and bool(ids) and page != max(ids)
        found.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(found, key=str)


def test_records(pages):
    assert sorted((tuple(r) for r in warc.archive_and_back(pages).collect()), key=str) == _expected()


def test_payloads_come_back_in_chunks(spark, pages):
    manifest = warc.write_archives(warc.chunk_rows(pages, size=5_000), output_folder(spark, "warc"))
    rows = warc.read_archives(manifest).collect()
    by_record = {}
    for r in rows:
        by_record.setdefault((r.page_id, r.record_type, r.payload_digest), {})[r.chunk_no] = r
    texts = {(p, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for p, _, h in ROWS}
    for (page, kind, digest), chunks in by_record.items():
        data = b"".join(bytes(chunks[i].chunk) for i in range(len(chunks)))
        expected = texts[None if page is None else int(page), digest]
        assert data == (expected if kind == "response" else b"")
        assert all(len(c.chunk) <= warc.CHUNK for c in chunks.values())
        done = hashlib.sha1()
        for i in range(len(chunks)):
            done.update(chunks[i].chunk)
            assert chunks[i].digest_so_far == done.hexdigest() and chunks[i].last == (i == len(chunks) - 1)
    # plain gzip reads the archives too, and they hold a record per page
    whole = b""
    for path in (r.path for r in manifest.collect()):
        store, place = open_store(path)
        whole += gzip.decompress(store.open_input_file(place).read())
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_a_wrong_digest_stops_the_writer(spark, pages):
    chunks = warc.chunk_rows(pages).withColumn("payload_digest", F.lit("0" * 40))
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.write_archives(chunks, output_folder(spark, "warc")).count()


@pytest.mark.parametrize("cut", [1, 30, 400])
def test_a_cut_archive_is_an_error(cut):
    data = warc._headers(
        {"record_type": "response", "page_id": "1", "payload_digest": "d", "uri": "u", "payload_bytes": 300, "refers_to": None}
    ) + b"x" * 300 + b"\r\n\r\n"
    assert len(list(warc.parse(iter([data, data])))) == 2
    with pytest.raises(ValueError):
        list(warc.parse(iter([data[:-cut]])))


def test_empty_table(spark):
    assert warc.archive_and_back(spark.createDataFrame([], PAGES)).count() == 0


def test_ids_of_any_characters(spark):
    ids = ["c", "c:d", "q:r>", "é /%3A", "", None]
    pages = spark.createDataFrame([(i, "u", "x" * 1_000 if i and "c" in i else "small") for i in ids], "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_back(pages).collect()}
    assert got == {("c", "revisit", "c:d"), *((i, "response", None) for i in ids if i != "c")}
