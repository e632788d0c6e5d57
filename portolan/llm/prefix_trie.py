"""The trie of what conversations begin with, by a skeleton of splitter paths.

A conversation is a path: the digests of its turns, one after the other. Paths are
sorted and cut into shards at splitters drawn from them. A node of the trie that is no
prefix of a splitter has all its conversations in one shard, so the task that walks the
shard in order finishes it. The prefixes of the splitters are the skeleton, a small trie
that every task is sent; for its nodes a task gives what its shard holds of them, and
these parts are added up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from portolan.llm.common import chunked, map_arrow, words, written

TURN = 16                       # bytes of a turn's digest
TURNS_PER_SHARD = 20_000
MOST_SHARDS = 4096
DRAWN = 16                      # conversations drawn for each shard
MOST_DRAWN_TURNS = 1 << 22      # of all of them together; a longer path is cut
MOST_PENDING = 10_000           # children that wait for their parent's name
ENDS_AT_ONCE = 1 << 16          # conversations in one part of a list of ends
_NOTHING = hashlib.sha256().hexdigest()


# Paths

def _digest(role: Column, text: Column) -> Column:
    whole = F.concat_ws(":", F.length(role).cast("string"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * TURN)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with `turns` in order: an array of (digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("bigint")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
            turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).alias("turn"),
            _digest(role, text).alias("digest"), F.size(words(text)).alias("words")).alias("turn")
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """`lists` with the first h turns of each conversation replaced by the first h of the
    one that its group of `group` ids starts with (none if that is absent), h being its
    number's CRC-32 modulo `heads`.

    `lists` is written. What is joined is `heads` - 1 turns of every `group`th id, met by
    `group` conversations each.
    """
    first = lists.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.slice("turns", 1, 0)
    joined = lists.join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("_first"), "left")
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("_head", none), F.lit(1), taken),
        F.slice("turns", taken + 1, F.size("turns"))).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """(conv_id, path, words): the digests as bytes, one after the other."""
    return lists.select(
        "conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"),
        F.col("turns.words").alias("words"))


# The skeleton

class Skeleton(NamedTuple):
    """The trie of the splitters. Node 0 is the root; a parent has a smaller number."""

    splitters: list[tuple[bytes, int]]  # path, conv_id, rising
    numbers: list[list[int]]            # of each splitter's prefixes, from depth 1
    parents: list[int]
    depths: list[int]


def skeleton(splitters: list[tuple[bytes, int]]) -> Skeleton:
    numbers, parents, depths, known = [], [-1], [0], {}
    for path, _ in splitters:
        own, at = [], 0
        for depth in range(1, len(path) // TURN + 1):
            turn = path[(depth - 1) * TURN:depth * TURN]
            if (at, turn) not in known:
                known[at, turn] = len(parents)
                parents.append(at)
                depths.append(depth)
            at = known[at, turn]
            own.append(at)
        numbers.append(own)
    return Skeleton(splitters, numbers, parents, depths)


def draw_splitters(found: DataFrame, per_shard: int = TURNS_PER_SHARD) -> list[tuple[bytes, int]]:
    """Splitters that cut `paths` into shards of about `per_shard` turns.

    They come from `DRAWN` conversations a shard, those with the smallest hashes, cut so
    that all of them have `MOST_DRAWN_TURNS` turns at most: a bounded draw. Equal paths
    are split by their conv_id, so a conversation that a third of all others repeat
    spreads over many shards.
    """
    turns = found.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = min(MOST_SHARDS, -(-turns // per_shard))
    if shards < 2:
        return []
    rows = shards * DRAWN
    drawn = found.orderBy(F.xxhash64("conv_id"), "conv_id").limit(rows).select(
        F.substring("path", 1, MOST_DRAWN_TURNS // rows * TURN).alias("path"), "conv_id",
        F.size("words").alias("turns")).collect()
    drawn = sorted((bytes(r.path), r.conv_id, r.turns + 1) for r in drawn)
    weight = np.cumsum([turns for _, _, turns in drawn])
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)
    return [drawn[i][:2] for i in np.unique(cuts).tolist()]


def _shared(one: bytes, two: bytes) -> int:
    """Turns that two paths begin with alike."""
    n, at = min(len(one), len(two)), 0
    while at < n and one[at:at + TURN] == two[at:at + TURN]:
        at += TURN
    return at // TURN


# A walk through a shard

# What a walk gives. A node's row, whole or with its parent's number in `node` for its
# parent's name; a shard's part of a skeleton node; a part of the list of conversations
# that end there; the name of a node that was given a number.
WHOLE, CHILD, PART, ENDS, NAME = range(5)
_ROW = [("kind", "int"), ("node", "bigint"), ("shard", "int"), ("place", "int"), ("conv_id", "bigint"),
        ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"),
        ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"),
        ("words", "bigint"), ("ends", "string")]
_DDL = ", ".join(f"{name} {kind}" for name, kind in _ROW)
_SCHEMA = pa.schema([(name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind])
                     for name, kind in _ROW])


class _Node:
    __slots__ = ("depth", "number", "words", "least", "convs", "children", "leaves", "saved",
                 "ends", "parts", "pending", "wide")

    def __init__(self, depth: int, number: int | None, words: int):
        self.depth, self.number, self.words = depth, number, words
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.parts, self.pending, self.wide = None, 0, [], None

    def meet(self, conv_id: int, convs: int) -> None:
        self.least = conv_id if self.least is None else min(self.least, conv_id)
        self.convs += convs


class _Walk:
    """One shard's conversations in order of path and conv_id. Holds the nodes on the
    way to the conversation at hand that others share, and for each at most `pending`
    children; what only one conversation passes is given at once."""

    def __init__(self, plan: Skeleton, shard: int, pending: int):
        self.shard, self.pending, self.named, self.out = shard, pending, 0, []
        self.edges = [(plan.splitters[i][0], plan.numbers[i]) for i in (shard - 1, shard)
                      if 0 <= i < len(plan.splitters)]
        self.stack = [_Node(0, 0, 0)]

    def give(self, kind: int, node: int | None, *, place=None, conv_id=None, depth=None, parent=None,
             convs=None, children=None, leaves=None, saved=None, words=None, ends=None) -> None:
        self.out.append((kind, node, self.shard, place, conv_id, depth, parent, convs, children,
                         leaves, saved, words, ends))

    def child(self, parent: _Node, row: dict) -> None:
        """A finished child; its row waits until the smallest conversation that passes
        its parent is known, or names the parent by number."""
        parent.children += 1
        if parent.number is None and parent.wide is None:
            parent.pending.append(row)
            if len(parent.pending) <= self.pending:
                return
            self.named += 1
            parent.wide = -(self.shard << 32 | self.named)
            rows, parent.pending = parent.pending, []
        else:
            rows = [row]
        number = parent.number if parent.number is not None else parent.wide
        for row in rows:
            self.give(CHILD, number, **row)

    def close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if node.number is not None:
            self.send_ends(node)
            leaves, saved = node.leaves, node.saved + node.convs * node.words
            self.give(PART, node.number, conv_id=node.least, convs=node.convs, leaves=leaves,
                      children=node.children, saved=saved, words=node.words)
        else:
            leaves = node.leaves or 1
            saved = node.saved + (node.convs - 1) * node.words
            for row in node.pending:
                self.give(WHOLE, None, parent=node.least, **row)
            if node.wide is not None:
                self.give(NAME, node.wide, conv_id=node.least)
            self.child(parent, dict(
                conv_id=node.least, depth=node.depth, convs=node.convs, children=node.children,
                leaves=leaves, saved=saved, ends=node.ends.hexdigest() if node.ends else _NOTHING))
        if parent is not None:
            parent.meet(node.least, node.convs)
            parent.leaves += leaves
            parent.saved += saved

    def end(self, node: _Node, conv_id: int) -> None:
        if node.number is not None:
            node.ends = node.ends or []
            node.ends.append(str(conv_id))
            if len(node.ends) == ENDS_AT_ONCE:
                self.send_ends(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv_id).encode())
        else:
            node.ends.update(f",{conv_id}".encode())

    def send_ends(self, node: _Node) -> None:
        if node.ends:
            self.give(ENDS, node.number, place=node.parts, ends=",".join(node.ends))
            node.ends, node.parts = None, node.parts + 1

    def conversation(self, path: bytes, conv_id: int, words: list[int], before: int, after: int) -> None:
        """A conversation that shares `before` turns with the last one and `after` with
        the next one of the shard."""
        while self.stack[-1].depth > before:
            self.close()
        known = [(_shared(path, edge), numbers) for edge, numbers in self.edges]
        for depth in range(before + 1, max(after, *(n for n, _ in known), 0) + 1):
            number = next((numbers[depth - 1] for n, numbers in known if depth <= n), None)
            self.stack.append(_Node(depth, number, words[depth - 1]))
        top, length = self.stack[-1], len(words)
        top.meet(conv_id, 1)
        if length == top.depth:
            self.end(top, conv_id)
            return
        ends = hashlib.sha256(str(conv_id).encode()).hexdigest()
        top.leaves += 1
        for depth in range(top.depth + 1, length + 1):
            last = depth == length
            row = dict(conv_id=conv_id, depth=depth, convs=1, children=0 if last else 1, leaves=1,
                       saved=0, ends=ends if last else _NOTHING)
            if depth == top.depth + 1:
                self.child(top, row)
            else:
                self.give(WHOLE, None, parent=conv_id, **row)

    def finish(self) -> None:
        while self.stack:
            self.close()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _walked(rows: Iterator[tuple], plan: Skeleton, pending: int) -> Iterator[tuple]:
    """The rows of all walks, for (shard, path, conv_id, words) in order."""
    walk, held, before = None, None, 0
    for row in rows:
        if held is not None:
            after = _shared(held[1], row[1]) if row[0] == held[0] else 0
            walk.conversation(*held[1:], before, after)
            before = after
            yield from walk.taken()
        if walk is None or row[0] != held[0]:
            if walk is not None:
                walk.finish()
                yield from walk.taken()
            walk, before = _Walk(plan, row[0], pending), 0
        held = row
    if held is not None:
        walk.conversation(*held[1:], before, 0)
        walk.finish()
        yield from walk.taken()


def walk_shards(found: DataFrame, plan: Skeleton, pending: int) -> DataFrame:
    """What the walks through all shards give, for `paths`."""
    shared = found.sparkSession.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value.splitters
        for batch in batches:
            shard = [bisect_left(splitters, key) for key in zip(
                batch["path"].to_pylist(), batch["conv_id"].to_pylist())]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(
            batch[c].to_pylist() for c in ("shard", "path", "conv_id", "words"))))
        yield from chunked(_walked(rows, shared.value, pending), _SCHEMA, 20_000)

    found = found.select("conv_id", "path", "words")
    dealt = map_arrow(found, deal, StructType.fromDDL(
        "conv_id bigint, path binary, words array<int>, shard int"))
    shards = len(plan.splitters) + 1
    return map_arrow(dealt.repartition(shards, "shard").sortWithinPartitions(
        "shard", "path", "conv_id"), walk, _DDL)


# Nodes

def _end_digests(given: DataFrame) -> DataFrame:
    """(_node, ends): digests of the skeleton nodes' lists, part after part as they are
    sorted, so that no list is ever held."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, running = None, None
            for batch in batches:
                for node, ends in zip(batch["node"].to_pylist(), batch["ends"]):
                    raw = ends.as_buffer()
                    if node == last:
                        running.update(b",")
                        running.update(raw)
                        continue
                    if running:
                        yield last, running.hexdigest()
                    last, running = node, hashlib.sha256(raw)
            if running:
                yield last, running.hexdigest()

        yield from chunked(rows(), pa.schema([("_node", pa.int64()), ("_ends", pa.string())]), 10_000)

    parts = given.where(F.col("kind") == ENDS).select("node", "shard", "place", "ends")
    return map_arrow(parts.repartition("node").sortWithinPartitions("node", "shard", "place").select(
        "node", "ends"), digest, "_node bigint, _ends string")


def _skeleton_rows(given: DataFrame, plan: Skeleton) -> list[tuple]:
    """The skeleton's nodes, from the sums of their parts (at most one row for a turn of a
    splitter, so the driver takes them). A part counts its skeleton nodes as if they had
    children and saved all their words; both are put right here, from the bottom."""
    parts = {r.node: r for r in given.where(F.col("kind") == PART).groupBy("node").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("convs"),
        F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("words").alias("words")).collect()}
    kids, childless, counted = ([0] * len(plan.parents) for _ in range(3))
    rows = []
    for node in range(len(plan.parents) - 1, -1, -1):
        part, parent = parts.get(node), plan.parents[node]
        if part is None:  # no conversations at all
            continue
        children = part.children + kids[node]
        childless[node] += children == 0
        counted[node] += part.words
        if parent >= 0:
            kids[parent] += 1
            childless[parent] += childless[node]
            counted[parent] += counted[node]
        rows.append((node, part.least, plan.depths[node], parts[parent].least if parent >= 0 else None,
                     part.convs, children, part.leaves + childless[node], part.saved - counted[node]))
    return rows


def prefix_nodes(lists: DataFrame, per_shard: int = TURNS_PER_SHARD,
                 pending: int = MOST_PENDING) -> DataFrame:
    """One row per node of the trie of `lists` (conv_id, turns; see `turn_lists`):
    conv_id, the smallest of the conversations that begin so; depth; parent_conv_id;
    n_convs; n_children; n_leaves, nodes without children at or below it; saved_tokens,
    the words that need not be repeated at or below it; ends_sha256 of the conversations
    that end there, comma-joined in rising order.

    A conversation's path is one row (20 bytes a turn). A walk streams: it holds the
    nodes that conversations share on one way down, not a shard.
    """
    spark = lists.sparkSession
    found = written(paths(lists), "paths")
    plan = skeleton(draw_splitters(found, per_shard))
    given = written(walk_shards(found, plan, pending), "walks")
    rows = spark.createDataFrame(_skeleton_rows(given, plan), (
        "node bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    trunk = rows.join(_end_digests(given), F.col("node") == F.col("_node"), "left").select(
        *columns, F.coalesce("_ends", F.lit(_NOTHING)).alias("ends_sha256"))
    names = rows.select(F.col("node").alias("_node"), F.col("conv_id").alias("_name")).unionByName(
        given.where(F.col("kind") == NAME).select(
            F.col("node").alias("_node"), F.col("conv_id").alias("_name")))
    columns.append(F.col("ends").alias("ends_sha256"))
    hung = given.where(F.col("kind") == CHILD).join(names, F.col("node") == F.col("_node")).withColumn(
        "parent_conv_id", F.col("_name")).select(*columns)
    return given.where(F.col("kind") == WHOLE).select(*columns).unionByName(hung).unionByName(trunk)


def rebuilt_trie(conversations: DataFrame, per_shard: int = TURNS_PER_SHARD,
                 pending: int = MOST_PENDING) -> DataFrame:
    """`prefix_nodes` of the conversations of a table (conv_id, turn, role, text), rebuilt
    as `rebuilt` says.

    Turns go by `turn`, NULL first, those that share one by the digest of role and text.
    A NULL role or text is empty; turns are equal if their 128-bit digests are. Rows that
    repeat are turns each. Rows with a NULL conv_id belong to no conversation and are
    left out. Other columns are not touched; an empty table gives no rows.
    """
    lists = written(turn_lists(conversations), "turns")
    return prefix_nodes(rebuilt(lists), per_shard, pending)
