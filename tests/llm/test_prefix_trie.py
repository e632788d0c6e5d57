"""The trie of conversations, against one built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.llm import prefix_trie
from portolan.llm.common import table
from tests.llm.conftest import rows_of

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]
CLASHING = ["path", "words", "turns", "_first", "_head", "node", "digest", "shard", "kind", "depth"]
BLANKS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]


def brute(rows):
    """The contract's rows for (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = defaultdict(list)
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        size = len([w for w in path[-1][1].translate(BLANKS).split(" ") if w]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * size
    return sorted(((
        min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids[path],
        leaves[path], saved[path], hashlib.sha256(",".join(
            str(c) for c in sorted(members) if rebuilt[c] == path).encode()).hexdigest())
        for path, members in nodes.items()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows):
        return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns(
            {name: F.lit("x") for name in CLASHING})
    return make


def check(conversations, rows, **options):
    got = prefix_trie.rebuilt_trie(conversations(rows), **options)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == brute(rows)


def branching(n, seed=0, width=3, depth=6):
    """Conversations whose turns are few, so that many begin alike."""
    random = np.random.default_rng(seed)
    return [(c, t, "user" if t % 2 else None, f"turn {random.integers(width)} " + "w " * int(t))
            for c in range(n) for t in range(int(random.integers(1, depth + 1)))]


@pytest.mark.parametrize("per_shard,pending", [(10**6, 10**4), (40, 10**4), (7, 2), (10**6, 1)])
def test_every_node_whatever_the_shards(conversations, per_shard, pending):
    check(conversations, branching(150), per_shard=per_shard, pending=pending)


def test_the_given_conversations_in_many_shards(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in given.collect()]
    got = prefix_trie.rebuilt_trie(given, per_shard=25)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == brute(rows)


def test_nulls_ties_repeats_and_turnless_conversations(conversations):
    taken = {c: zlib.crc32(str(c).encode()) % 4 for c in range(100)}
    turnless = next(c for c in range(21, 40) if taken[c] > 1)
    rows = [(0, 1, "a", "x y"), (0, None, None, None), (0, 1, "a", "b"), (0, 1, "a", "b"), (0, 0, "", ""),
            (turnless, 5, "u", "gone"), (7, None, "a", "x y"), (7, None, "a", "x y"), (-7, 2, "n", "m"),
            (-20, 1, "n", "first"), (-33, 1, "n", "q"), (None, 1, "a", "lost"), (40, 1, None, "\t \n"),
            (41, 1, "a", "b:c"), (42, 1, "a:b", "c"), (9, 1, "é", "   ")]
    check(conversations, rows)
    check(conversations, rows, per_shard=2, pending=1)


def test_equal_conversations_spread_over_shards(conversations):
    rows = [(c, t, "u", f"same {t}") for c in range(0, 2000, 20) for t in range(5)]
    rows += [(c, t, "u", f"same {t}" if t < 3 else f"{c} {t}") for c in range(5, 2000, 20) for t in range(6)]
    check(conversations, rows, per_shard=50)
    lists = prefix_trie.turn_lists(conversations(rows))
    splitters = prefix_trie.draw_splitters(prefix_trie.paths(lists), 50)
    assert len(splitters) > 10 and len({path for path, _ in splitters}) < len(splitters)


def test_a_long_list_of_ends_comes_in_parts(spark):
    n = prefix_trie.ENDS_AT_ONCE + 1000
    same = spark.range(0, 20 * n, 20).select(
        F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"),
        F.lit("two words").alias("text"))
    ends = hashlib.sha256(",".join(map(str, range(0, 20 * n, 20))).encode()).hexdigest()
    for per_shard in (20_000, 10**6):
        got = rows_of(prefix_trie.rebuilt_trie(same, per_shard))
        assert got == [(0, 0, None, n, 1, 1, 2 * (n - 1), hashlib.sha256().hexdigest()),
                       (0, 1, 0, n, 0, 1, 2 * (n - 1), ends)]


def test_one_very_long_conversation(spark):
    n = 30_000
    long = spark.range(n).select(
        F.explode(F.array(F.lit(0), F.lit(20))).alias("conv_id"), F.col("id").alias("turn"),
        F.lit("u").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = prefix_trie.rebuilt_trie(long, per_shard=5000)
    assert got.count() == n + 1
    last = got.where(F.col("depth") == n).first()
    assert (last.conv_id, last.n_convs, last.parent_conv_id) == (0, 2, 0)
    assert last.ends_sha256 == hashlib.sha256(b"0,20").hexdigest()
    assert got.where("depth = 0").first().saved_tokens == n


def test_no_conversations_give_no_rows(conversations):
    assert prefix_trie.rebuilt_trie(conversations([(1, 1, "a", "b")]).limit(0)).isEmpty()
    assert prefix_trie.rebuilt_trie(conversations([(None, 1, "a", "b")])).isEmpty()


def test_very_long_texts(conversations):
    rows = [(c, 1, "u", "word " * 200_000 + str(c // 40)) for c in (0, 1, 20, 40)]
    check(conversations, rows)
