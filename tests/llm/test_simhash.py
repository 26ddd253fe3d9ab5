"""Fingerprints, links and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tallywick.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _plain_fingerprint(text, k=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A\tB c\x0bd e f g", "É x y z w " * 40])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text) == _plain_fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 3)
    assert simhash.fingerprint(text) == _plain_fingerprint(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=4, unique=True), st.integers(0, 2**64 - 1))
def test_every_link_starts_a_chain(bits, value):
    """The pigeonring bound: near fingerprints always have a start, whose key the join asks for."""
    difference = sum(1 << b for b in bits)
    segments = simhash.ring(4)
    parts = len(segments)
    counts = [bin(difference >> o & ((1 << w) - 1)).count("1") for o, w in segments]
    starts = [
        s for s in range(parts) if all(sum(counts[(s + i) % parts] for i in range(n)) <= n * 4 // parts for n in range(1, parts + 1))
    ]
    assert starts and all(counts[s] == 0 and counts[(s + 1) % parts] <= 1 for s in starts)


def test_links_and_components(spark):
    rng = random.Random(4)
    values = {0, 2**63, 2**64 - 1}
    for _ in range(40):
        value = rng.getrandbits(64)
        for _ in range(6):
            values.add(value)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                value ^= 1 << bit
    signed = [int(np.uint64(v).view(np.int64)) for v in sorted(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    expected = {
        (min(a, b), max(a, b)) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    }
    got = [tuple(r) for r in simhash.links(prints).collect()]
    assert len(got) == len(set(got)) and set(got) == expected

    root = {v: v for v in signed}
    for _ in signed:
        for a, b in expected:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
    assert found == {v: root[v] for v in signed if any(v in e for e in expected)}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [
        (5, long), (3, long.upper()), (9, long + " more"), (7, "nothing like it at all"), (2, None), (8, ""), (6, " \t"),
        (7, "nothing like it at all"), (None, long), (None, "alone and without an id"),
    ]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(_docs(spark, rows)).collect()), key=str)
    expected = [(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (2, 2), (8, 2), (6, 2), (None, 3), (None, None)]
    assert got == sorted(expected, key=str)


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (7, "quite another text"), (1, None), (2, ""), (None, "without id")]
    docs = _docs(spark, rows).withColumnRenamed("source", "fingerprint").withColumnRenamed("lang", "component_id")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, 7, None]


def test_empty_table(spark):
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0
    assert simhash.keep_one(_docs(spark, [])).count() == 0
