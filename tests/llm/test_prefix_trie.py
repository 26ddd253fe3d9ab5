"""The prefix trie against counting every prefix in memory."""

import hashlib
import random
import re
from zlib import crc32

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywick.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    opening = {c: crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: opening[c]] + turns[opening[c] :] for c, turns in own.items()}


def _expected(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def words(path):
        return len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0

    found = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        found.append(
            (
                min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children.get(path, [])),
                sum(p not in children for p in below), sum((len(members[p]) - 1) * words(p) for p in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(found, key=str)


def _got(df):
    assert tuple(df.columns) == FIELDS
    return sorted(map(tuple, df.collect()), key=str)


def _rows(seed, convs=60, longest=7, texts=3):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(convs * 2), convs):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["a b", "", None, "x", "long\ttext\n here"][: texts + 2])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_query_rows(spark, seed):
    rows = _rows(seed) + [(None, 0, "user", "no conversation"), (5_000, None, "user", "first"), (5_000, -3, "user", "second")]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert _got(prefix_trie.conversation_trie(df)) == _expected(_rebuilt(rows))


def test_long_conversations_cross_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    draw = random.Random(4)
    base = [("u", draw.choice("ab")) for _ in range(20)]
    convs = {c: base[: draw.randint(0, 20)] + [("u", draw.choice("ab")) for _ in range(draw.randint(0, 6))] for c in range(30)}
    convs |= {100 + i: base for i in range(9)} | {200: []}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, ROWS))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert _got(prefix_trie.prefix_trie(turns, ids, segment=3, most=40)) == _expected(convs)


def test_counts_handed_on_early_add_up(spark):
    rows = _rows(9)
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, ROWS))
    segments = prefix_trie._segments(turns, turns.select("conv_id").distinct()).coalesce(1)
    given = segments, prefix_trie._member_values, prefix_trie._add_member, "n long, conv_id long, words long"
    whole, early = (prefix_trie._combined(*given, most=most) for most in (10**6, 5))
    assert early.count() > whole.count() == whole.select("name").distinct().count()
    total = [df.groupBy("name").agg(F.sum("n"), F.min("conv_id")) for df in (whole, early)]
    assert not total[0].exceptAll(total[1]).count() and not total[1].exceptAll(total[0]).count()


def test_empty_and_other_columns(spark):
    empty = spark.createDataFrame([], ROWS)
    assert _got(prefix_trie.conversation_trie(empty)) == []
    rows = [(20, 0, "user", "hi"), (21, 0, "user", "hi"), (21, 0, "user", "hi"), (23, 0, None, None)]
    extra = spark.createDataFrame(rows, ROWS).withColumn("place", F.lit("p")).withColumn("count", F.lit(1)).withColumn("name", F.lit("n"))
    assert _got(prefix_trie.conversation_trie(extra)) == _expected(_rebuilt(rows))


KEYS = st.lists(st.binary(min_size=0, max_size=12).map(lambda b: b[: len(b) // 2 * 2]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(KEYS)
def test_tree_holds_every_prefix(keys):
    def merge(slot, value):
        slot[0] += value[0]

    tree = prefix_trie.Tree(merge, turn=2)
    for key in keys:
        tree.insert(key, [(1,)] * (len(key) // 2 + 1))
    want = {}
    for key in keys:
        for d in range(len(key) // 2 + 1):
            want[key[: 2 * d]] = want.get(key[: 2 * d], 0) + 1
    got = {state: slot[0] for _, _, state, slot in tree.walk(b"", lambda s, turn, d: s + turn)} if keys else {}
    assert got == want


def test_nodes_grow_through_all_layouts():
    tree = prefix_trie.Tree(lambda slot, value: None, turn=1)
    layouts = []
    for byte in random.Random(3).sample(range(256), 256):
        tree.insert(bytes([byte, 7]), [(1,)] * 3)
        layouts.append(tree.root.layout)
    assert [layouts[i] for i in (0, 3, 4, 15, 16, 47, 48, 255)] == [4, 4, 16, 16, 48, 48, 256, 256]
    assert sorted(n.edge[0] for n in tree.root.below()) == list(range(256))
    assert all(len(n.edge) == 2 for n in tree.root.below())  # no branch, one edge
