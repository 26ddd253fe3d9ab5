"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into a ring of ``distance + 1`` segments. If two fingerprints differ in at most
``distance`` bits, some segment starts a chain all of whose prefixes stay within their proportional share of the
difference: a prefix of ``l`` segments differs in at most ``l * distance / (distance + 1)`` bits. So a link has a
start whose first segment is equal and whose second differs in at most one bit. These two segments are the key of
the candidate join (one side stores them, the other asks for all variants of the second), the longer prefixes and
the place of the first such start are tested on the joined pair, and the full Hamming distance comes last.

Equal fingerprints are one class, so copies never meet in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallywick.llm.storage import free_names, materialize, own_columns

BITS = 64
SHINGLE = 4
DISTANCE = 4
_SEED = 42
# shingles hashed at once, which bounds the memory a very long text takes
_BLOCK = 1 << 16


# --- fingerprints ---------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned integer; a text without words (null, empty, blank) has zero.

    A-Z are lowered, words are runs of bytes other than ASCII white space, shingles are joined by a space, and a
    text of fewer words is one shingle. A bit is set if over half of the shingles' hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, shingles, _BLOCK):
        stop = min(shingles, start + _BLOCK)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), _SEED) for i in range(start, stop)),
            dtype=np.uint64,
            count=stop - start,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view(np.uint64)[0])


def with_fingerprints(
    docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE, name: str = "fingerprint"
) -> DataFrame:
    """``keys`` of every row and its fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(len(keys)).to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], names=[*keys, name])

    chosen = docs.select(*(docs[k] for k in keys), docs[text].cast("string").alias("__text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return chosen.mapInArrow(run, f"{schema}, `{name}` long")


# --- pigeonring join ------------------------------------------------------------------------------------


def ring(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """``(offset, width)`` of the segments: ``distance + 1`` of them, as even as can be."""
    parts = distance + 1
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(offset: int, width: int) -> int:
    """The segment's bits as a signed 64-bit integer."""
    return int(np.uint64(((1 << width) - 1) << offset).view(np.int64))


def _differing(x: Column, segments: list[tuple[int, int]]) -> Column:
    mask = reduce(lambda a, b: a | b, (_mask(*s) for s in segments))
    return F.bit_count(x.bitwiseAND(F.lit(mask)))


def _starts_chain(x: Column, segments: list[tuple[int, int]], start: int, distance: int) -> Column:
    """Whether every prefix of the ring from ``start`` stays within its share of the difference ``x``."""
    parts = len(segments)
    order = [segments[(start + i) % parts] for i in range(parts)]
    return reduce(
        lambda a, b: a & b,
        (_differing(x, order[:length]) <= F.lit(length * distance // parts) for length in range(1, parts + 1)),
    )


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` (``a < b``) of distinct fingerprints that differ in at most ``distance`` bits, each once.

    ``prints`` has one column of distinct fingerprints. Nothing is left out, whatever the number of partners.
    """
    column = prints.columns[0]
    if distance < 1:
        return prints.select(F.col(column).alias("a"), F.col(column).alias("b")).where(F.lit(False))
    segments = ring(distance)
    parts = len(segments)
    own = prints.select(F.col(column).alias("f"))

    def key(start: int, flips: list[int]) -> list[Column]:
        (_, _), (offset, _) = segments[start], segments[(start + 1) % parts]
        both = _mask(*segments[start]) | _mask(*segments[(start + 1) % parts])
        kept = F.col("f").bitwiseAND(F.lit(both))
        return [
            F.struct(F.lit(start).alias("start"), kept.bitwiseXOR(F.lit(_mask(offset + bit, 1) if bit >= 0 else 0)).alias("part"))
            for bit in flips
        ]

    widths = [segments[(s + 1) % parts][1] for s in range(parts)]
    stored = own.select(F.col("f").alias("a"), F.explode(F.array(*[k for s in range(parts) for k in key(s, [-1])])).alias("k"))
    asked = own.select(
        F.col("f").alias("b"),
        F.explode(F.array(*[k for s in range(parts) for k in key(s, [-1, *range(widths[s])])])).alias("k"),
    )
    difference = F.col("a").bitwiseXOR(F.col("b"))
    chains = [_starts_chain(difference, segments, s, distance) for s in range(parts)]
    first = F.coalesce(*(F.when(chain, F.lit(s)) for s, chain in enumerate(chains)))
    return (
        stored.select("a", F.col("k.start").alias("start"), F.col("k.part").alias("part"))
        .join(
            asked.select("b", F.col("k.start").alias("start2"), F.col("k.part").alias("part2")),
            (F.col("start") == F.col("start2"))
            & (F.col("part") == F.col("part2"))
            & (F.col("a") < F.col("b"))
            & (F.bit_count(difference) <= distance)
            & (F.col("start") == first),
        )
        .select("a", "b")
    )


# --- components -----------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``); the root is the least node that can be reached.

    Large-star and small-star steps in turn: each keeps connections and hangs nodes on smaller ones, until a round
    changes nothing. A round's edges are written to the shared folder, so lineage stays short and a lost executor
    repeats little.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        then = materialize(small, "links")
        if then.count() == now.count() and then.exceptAll(now).isEmpty():
            break
        now = then
    roots = then.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(
    docs: DataFrame,
    keys: list[str] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per row of ``docs``: its ``keys`` (the id alone, if not given), ``fingerprint``, ``component_id``.

    * ``component_id`` is the least ``doc_id`` reachable over links, the row's own included; null ids are never it
      unless a component has no other.
    * Null and empty texts, and those of white space only, have fingerprint zero and link like any other.
    * Repeated rows each get a row; an empty table gives an empty result. Other columns are not read.
    """
    keys = keys or [doc_id]
    name, root, least = free_names(docs.select(*keys), "fingerprint", "root", "component_id")
    prints = materialize(with_fingerprints(docs, keys, text, shingle, name), "fingerprints")
    classes = prints.groupBy(name).agg(F.min(doc_id).alias(least))
    found = components(links(classes.select(name), distance))
    # only linked classes need their component's least id; the others have their own
    linked = classes.join(found.select(F.col("node").alias(name), F.col("root").alias(root)), name)
    smallest = linked.groupBy(root).agg(F.min(least).alias(least))
    linked = linked.drop(least).join(smallest, root).select(name, F.col(least).alias(f"{least}_linked"))
    by_class = classes.join(linked, name, "left").select(name, F.coalesce(f"{least}_linked", least).alias(least))
    return prints.join(by_class, name).select(*keys, name, least)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one whose id names it.

    Rows that repeat an id and a text stay or go together; so do rows without an id, of components that have none.
    """
    content, gone_id, gone_content = free_names(docs, "content", "gone_id", "gone_content")
    marked = docs.withColumn(content, F.xxhash64(docs[text]))
    groups = near_duplicates(marked, [doc_id, content], text, doc_id, shingle, distance)
    gone = groups.where(~F.col(doc_id).eqNullSafe(F.col("component_id"))).select(
        F.col(doc_id).alias(gone_id), F.col(content).alias(gone_content)
    )
    match = F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(content) == F.col(gone_content))
    return marked.join(gone, match, "left_anti").select(*own_columns(docs))
