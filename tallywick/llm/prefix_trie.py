"""The prefix trie of conversations: which turns they share, counted once per node.

A turn is a fixed-width big-endian id (the first 16 bytes of the SHA-256 of its role and text), a conversation the
string of its turns' ids. Tasks insert such strings into adaptive radix trees: inner nodes have room for 4, 16, 48 or
256 children and grow when full, and runs of bytes without a branch are one edge. Only byte depths that end a turn
emit nodes; their partial counts from all tasks are added up by Spark.

Nothing has to meet in one task to be counted: a tree is a combiner over whatever strings a task holds, and a first turn
shared by a third of all conversations leaves each task as one row. Long conversations are cut into segments of
``SEGMENT`` turns, which begin where the turns before them end. A node is known by the sum of its turns' hashes, each
hash taken with the turn's place, so that segments need no more of those before them than a sum.

A conversation's own nodes are those of which it is the smallest member: a run from some depth to its end. So what a
subtree adds up can be added up over its members, without walking up the trie: its leaves are the members' ends that
are their own and childless, and the tokens it saves are those of its members' turns that are not their own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywick.llm.storage import materialize
from tallywick.operators.numbering import numbered

#: Bytes of a turn's id.
TURN = 16
#: Turns in a row of the table of segments.
SEGMENT = 64
#: Turn-aligned nodes a task keeps before it hands on what it has counted.
HELD = 300_000
#: Ids of conversations in a piece of text that is hashed.
PIECE = 4_096
#: A node with more than this share of all nodes below it is looked up by a broadcast; there are at most so many.
HOT = 1_000

_LANES = ("lane0", "lane1", "lane2", "lane3")


# --- the tree -------------------------------------------------------------------------------------------


class Node:
    """A node of the radix tree: its edge, a payload for each turn that ends on the edge, and its children.

    Up to 4 and up to 16 children are sorted bytes beside a list, up to 48 an index of 256 places into a list, more
    a list of 256 places.
    """

    __slots__ = ("edge", "slots", "layout", "keys", "children", "count")

    def __init__(self, edge: bytes, slots: list):
        self.edge, self.slots = edge, slots
        self.layout, self.keys, self.children, self.count = 4, bytearray(), [], 0

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Adds a child, or replaces the one of the same byte."""
        if self.layout <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.children[at] = child
                return
        elif self.find(byte) is not None:
            if self.layout == 48:
                self.children[self.keys[byte] - 1] = child
            else:
                self.children[byte] = child
            return
        if self.count == self.layout:
            self._grow()
        self.count += 1
        if self.layout <= 16:
            at = next((i for i, k in enumerate(self.keys) if k > byte), len(self.keys))
            self.keys.insert(at, byte)
            self.children.insert(at, child)
        elif self.layout == 48:
            self.children.append(child)
            self.keys[byte] = len(self.children)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for place, byte in enumerate(self.keys, 1):
                index[byte] = place
            self.layout, self.keys = 48, index
        else:
            self.children = [self.children[p - 1] if p else None for p in self.keys]
            self.layout, self.keys = 256, bytearray()

    def below(self) -> Iterator[Node]:
        return (child for child in self.children if child is not None)


class Tree:
    """Strings of turn ids with payloads, which ``merge`` adds up where strings share turns."""

    def __init__(self, merge: Callable[[list, tuple], None], turn: int = TURN):
        self.merge, self.turn = merge, turn
        self.root = Node(b"", [])

    def _meet(self, slots: list, values: list[tuple]) -> None:
        for slot, value in zip(slots, values):
            self.merge(slot, value)

    def insert(self, key: bytes, values: list[tuple]) -> int:
        """Adds a string with its payloads, at depth 0 and after each turn; returns how many nodes are new."""
        turn, node, at = self.turn, self.root, 0
        if node.slots:
            self.merge(node.slots[0], values[0])
        else:
            node.slots = [list(values[0])]
        values = values[1:]
        while at < len(key):
            child = node.find(key[at])
            if child is None:
                slots = [list(v) for v in values[at // turn :]]
                node.put(key[at], Node(key[at:], slots))
                return len(slots)
            edge = child.edge
            if not key.startswith(edge, at):
                same = _common(edge, key, at)
                if at + same == len(key):  # the string ends on the edge, at the end of a turn
                    self._meet(child.slots, values[at // turn :])
                    return 0
                held = (at + same) // turn - at // turn
                upper = Node(edge[:same], child.slots[:held])
                child.edge, child.slots = edge[same:], child.slots[held:]
                upper.put(edge[same], child)
                node.put(key[at], upper)
                child, edge = upper, upper.edge
            self._meet(child.slots, values[at // turn :])
            node, at = child, at + len(edge)
        return 0

    def walk(self, start, step: Callable) -> Iterator[tuple]:
        """``(depth, state of the parent, state, payload)`` of all nodes that end a turn, parents first.

        The root's state is ``start``, that of others ``step(state of the parent, turn, depth)``. Edges may begin and
        end within a turn.
        """
        yield 0, None, start, self.root.slots[0]
        stack = [(child, 0, b"", start) for child in self.root.below()]
        while stack:
            node, depth, path, state = stack.pop()
            path += node.edge
            for i, slot in enumerate(node.slots):
                depth += 1
                above, state = state, step(state, path[i * self.turn : (i + 1) * self.turn], depth)
                yield depth, above, state, slot
            rest = path[len(node.slots) * self.turn :]
            stack.extend((child, depth, rest, state) for child in node.below())


def _common(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of the edge agree with the string from ``at`` on."""
    most = min(len(edge), len(key) - at)
    differ = int.from_bytes(edge[:most], "big") ^ int.from_bytes(key[at : at + most], "big")
    return most - (differ.bit_length() + 7) // 8


# --- nodes' names ---------------------------------------------------------------------------------------


def _turn_hash(turn: bytes, place: int) -> tuple[int, ...]:
    """Four numbers of 32 bits for a turn at its place; :func:`_lanes` says the same in SQL."""
    return struct.unpack(">4I", hashlib.sha256(f"{turn.hex().upper()}:{place}".encode()).digest()[:16])


def _lanes(turn_hex: str, place: str) -> list[Column]:
    digest = F.sha2(F.concat(F.col(turn_hex), F.lit(":"), F.col(place).cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _name(lanes: list[str]) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.col(c)), 16, "0") for c in lanes)))


# --- tables ---------------------------------------------------------------------------------------------


def turns_of(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, place, turn_id, words`` of every row: its place from 1 in its conversation, its id in hexadecimal.

    Ordered by turn, null first; rows of equal turns by their ids, so equal ones may change places without effect.
    Null roles and texts are empty. Rows without a conversation belong to none and are left out.
    """
    who, said = F.coalesce(rows[role], F.lit("")), F.coalesce(rows[text], F.lit(""))
    given = rows.where(rows[conv_id].isNotNull()).select(
        rows[conv_id].cast("long").alias("conv_id"),
        rows[turn].alias("turn"),
        F.upper(F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * TURN)).alias("turn_id"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("turn_id").asc()]
    return numbered(given, ["conv_id"], order, "place", "n_turns").select("conv_id", "place", "turn_id", "words")


def with_shared_openings(turns: DataFrame, every: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the openings of every 20th one, and the ids of all of them.

    Conversation ``c`` begins with the first ``crc32(c) % longest`` turns of ``c - c % every`` (all, if it has fewer;
    none, if it is absent), then goes on with its own turns after as many.
    """
    c = F.col("conv_id")
    opening = F.crc32(c.cast("string")) % longest
    heads = (
        turns.where((F.col("place") < longest) & (c % every == 0))
        .groupBy(c.alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "words"))).alias("head"))
    )
    convs = turns.select("conv_id").distinct().withColumn("base", c - c % every)
    plan = convs.join(heads, "base", "left").select(
        "conv_id", F.coalesce(F.slice("head", F.lit(1), opening.cast("int")), F.array()).alias("head")
    )
    plan = materialize(plan, "openings")
    opened = plan.select("conv_id", F.inline("head")).select("conv_id", "place", "turn_id", "words")
    sizes = plan.select("conv_id", F.size("head").cast("long").alias("taken"))
    own = turns.where(F.col("place") > opening).join(sizes, "conv_id")
    moved = own.select("conv_id", (F.col("taken") + F.col("place") - opening).alias("place"), "turn_id", "words")
    return opened.unionByName(moved), plan.select("conv_id")


def _segments(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation and ``segment`` turns: their ids, words, hash, and the hash of all turns before."""
    none = F.lit(None)
    marked = turns.unionByName(
        convs.select("conv_id", F.lit(0).cast("long").alias("place"), none.cast("string").alias("turn_id"), F.lit(0).cast("long").alias("words"))
    )
    with_lanes = marked.select("*", *(lane.alias(n) for lane, n in zip(_lanes("turn_id", "place"), _LANES)))
    turn = F.when(F.col("place") > 0, F.struct("place", "turn_id", "words"))
    rows = with_lanes.groupBy("conv_id", F.greatest(F.floor((F.col("place") - 1) / segment), F.lit(0)).alias("segment")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _LANES)
    )
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "conv_id",
        "segment",
        F.unhex(F.array_join(F.col("turns.turn_id"), "")).alias("ids"),
        F.col("turns.words").alias("words"),
        *_LANES,
        *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in _LANES),
    )


def _emitted(trees: dict, length: int) -> Iterator[list]:
    """``name, parent's name, depth, payload`` of all nodes; the root of a later segment is the end of the one before."""
    for (segment, start), tree in trees.items():
        before = segment * length

        def step(sums, turn, depth):
            return tuple(map(int.__add__, sums, _turn_hash(turn, before + depth)))

        for depth, above, sums, slot in tree.walk(start, step):
            if depth or not segment:
                yield [_packed(sums), above and _packed(above), before + depth, *slot]


def _packed(sums: tuple[int, ...]) -> bytes:
    return struct.pack(">4Q", *sums)


def _combined(
    segments: DataFrame, values: Callable, merge: Callable, fields: str, segment: int = SEGMENT, most: int = HELD
) -> DataFrame:
    """Partial nodes of all segments: ``name, parent, depth`` and the payload ``fields``, once per tree they occur in."""
    schema = f"name binary, parent binary, depth long, {fields}"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * (len(names) - 2)]

    def rows(trees: dict) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _emitted(trees, segment):
            held.append(row)
            if len(held) == 20_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                start = tuple(row[f"{n}_before"] for n in _LANES)
                tree = trees.get((row["segment"], start))
                if tree is None:
                    tree = trees[row["segment"], start] = Tree(merge)
                held += tree.insert(row["ids"], values(row))
                if held > most:
                    yield from rows(trees)
                    trees, held = {}, 0
        yield from rows(trees)

    return segments.mapInArrow(run, schema)


def _member_values(row: dict) -> list[tuple]:
    return [(1, row["conv_id"], w) for w in [0, *row["words"]]]


def _add_member(slot: list, value: tuple) -> None:
    slot[0] += value[0]
    if value[1] < slot[1]:
        slot[1] = value[1]


def _shared_values(row: dict) -> list[tuple]:
    """After each turn, the words of the conversation's shared turns from there on, and whether it ends in a leaf."""
    saved, found = row["later"], []
    for i in range(len(row["words"]) - 1, -1, -1):
        if i < row["shared"]:
            saved += row["words"][i]
        found.append((saved, row["leaf"]))
    found.append((saved, row["leaf"]))
    return found[::-1]


def _add_shared(slot: list, value: tuple) -> None:
    slot[0] += value[0]
    slot[1] += value[1]


def _ends(segments: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the nodes at which conversations end: the digest of their ids in ascending order.

    Ids meet in pieces of ``PIECE`` at most; a node's pieces are hashed in order, one at a time.
    """
    ends = segments.groupBy("conv_id").agg(*(F.sum(n).alias(n) for n in _LANES))
    block = F.floor(F.col("conv_id") / PIECE).alias("block")
    pieces = (
        ends.groupBy(_name(list(_LANES)).alias("name"), block)
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
        .repartition("name")
        .sortWithinPartitions("name", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name == last:
                    digest.update(b"," + piece.encode())
                    continue
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = name, hashlib.sha256(piece.encode())
            if done:
                yield _digests(done)
        if last is not None:
            yield _digests([(last, digest.hexdigest())])

    return pieces.mapInArrow(run, "name binary, ends_sha256 string")


def _digests(done: list) -> pa.RecordBatch:
    names, digests = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests)], names=["name", "ends_sha256"])


def _with_parents(nodes: DataFrame, owners: DataFrame, children: DataFrame) -> DataFrame:
    """``name, parent_conv_id`` of all nodes but the root.

    Within a conversation's own run the parent is its own; only the run's first node has to look it up. A node with
    many children, as the root or a common first turn, is sent to their tasks instead of meeting them in one.
    """
    placed = nodes.where(F.col("depth") > 0).join(owners.select("conv_id", "first_own"), "conv_id")
    inner = placed.where(F.col("depth") > F.col("first_own")).select("name", F.col("conv_id").alias("parent_conv_id"))
    heads = placed.where(F.col("depth") == F.col("first_own")).select("name", "parent")
    known = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    total = children.agg(F.sum("n_children").alias("total")).scalar()
    # each has over a thousandth of all children: at most a thousand rows
    many = children.where(F.col("n_children") * HOT > total).select("parent")
    hot = F.broadcast(known.join(F.broadcast(many), "parent"))
    rest = heads.join(F.broadcast(many), "parent", "left_anti")
    return inner.unionByName(heads.join(hot, "parent").select("name", "parent_conv_id")).unionByName(
        rest.join(known, "parent").select("name", "parent_conv_id")
    )


def prefix_trie(
    turns: DataFrame, convs: DataFrame | None = None, segment: int = SEGMENT, most: int = HELD
) -> DataFrame:
    """The trie's nodes: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, place, turn_id, words`` as :func:`turns_of` gives them, each place of a conversation once;
    ``convs`` the ids of all conversations, if some have no turn (they are members of the root, and end there). Strings
    are cut every ``segment`` turns; a task holds about ``most`` nodes.

    * A node is a sequence of turns; conversations of equal turns share all their nodes.
    * The root has depth 0 and no parent. Without conversations there is no node.
    * ``saved_tokens`` counts, over the subtree, the words of a node's turn for every member but one.
    * Other columns of ``turns`` are not read.
    """
    convs = turns.select("conv_id").distinct() if convs is None else convs
    segments = materialize(_segments(turns.select("conv_id", "place", "turn_id", "words"), convs, segment), "segments")
    partial = _combined(segments, _member_values, _add_member, "n_convs long, conv_id long, words long", segment, most)
    nodes = materialize(
        partial.groupBy("name").agg(
            F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
        ),
        "nodes",
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    tree = materialize(
        nodes.join(children.withColumnRenamed("parent", "name"), "name", "left").na.fill(0, ["n_children"]), "tree"
    )
    # the deepest node of a conversation's own run is its end
    owners = materialize(
        tree.groupBy("conv_id").agg(
            F.min("depth").alias("first_own"), F.max_by("n_children", "depth").alias("after_end")
        ),
        "owners",
    )
    before = F.col("segment") * segment
    later = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    shared = F.least(F.greatest(F.coalesce(F.col("first_own") - 1 - before, F.lit(segment)), F.lit(0)), F.lit(segment)).cast("int")
    own = (
        segments.join(owners, "conv_id", "left")
        .withColumn("shared", shared)
        .withColumn("leaf", F.when(F.col("after_end") == 0, 1).otherwise(0))
        .withColumn("here", F.aggregate(F.slice("words", F.lit(1), F.col("shared")), F.lit(0).cast("long"), lambda a, w: a + w))
        .withColumn("later", F.coalesce(F.sum("here").over(later), F.lit(0)))
    )
    sums = (
        _combined(own, _shared_values, _add_shared, "saved_tokens long, n_leaves long", segment, most)
        .groupBy("name")
        .agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    )
    inner = tree.where(F.col("n_children") > 0).select(F.col("name").alias("parent"), "n_children")
    parents = _with_parents(tree, owners, inner)
    nothing = hashlib.sha256(b"").hexdigest()
    found = tree.join(sums, "name").join(parents, "name", "left").join(_ends(segments), "name", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations in ``rows``, rebuilt with shared openings."""
    return prefix_trie(*with_shared_openings(materialize(turns_of(rows), "turns")))
