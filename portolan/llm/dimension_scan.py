"""Nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are dealt to the list of their nearest centroid and turned by one random rotation,
after which every few dimensions say as much about a distance as any others. A list is
kept in column blocks. A query goes through the lists nearest to it, block by block: the
distance in the dimensions seen so far estimates the whole one, and a candidate is
abandoned as soon as the estimate is so far beyond the distance to beat that chance does
not explain it. What is left at the end is measured on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from portolan.llm.common import map_arrow, ship, written
from portolan.llm.pivot_index import usable

NEAREST = 10
SAMPLE = 20_000             # vectors that the index is fitted on, at most
MOST_LISTS = 2048
LEAST_LIST = 64             # vectors of a list, on average
ROUNDS = 10                 # of moving centroids
TRIED = 256                 # sampled vectors that are searched to see how many lists a query needs
FOUND = 0.99                # of their neighbours that lie in as many lists
FIRST = 2                   # lists that set the distance to beat
COLUMNS = 16                # dimensions of a column block
DOUBT = 2.1                 # a candidate is abandoned beyond 1 + DOUBT / sqrt(dimensions seen)
MOST_VALUES = 1 << 20       # components of a block of a list; pairs that are scanned at once
MOST_QUERIES = 1 << 12      # queries that meet a block in one task
SEED = 5


# The index

class Space(NamedTuple):
    """How vectors of one length are dealt out."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int             # lists that a query goes through
    lengths: np.ndarray     # of the lists


class Index(NamedTuple):
    spaces: dict[int, Space]
    blocks: DataFrame       # size, list, block, ids, columns, vectors: one row per block


def _squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (np.square(rows).sum(axis=1)[:, None] + np.square(points).sum(axis=1)[None, :]
            - 2 * rows @ points.T)


def _tiles(n: int, width: int) -> Iterator[slice]:
    step = max(1, MOST_VALUES // max(1, width))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def _nearest_list(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(_squared(rows[part], centroids), axis=1)
                           for part in _tiles(len(rows), len(centroids))])


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows by the largest component of all, so that no square overflows."""
    return rows / (np.abs(rows).max() or 1.0)


def _space(sample: np.ndarray, wanted: int) -> Space:
    """Rotation, centroids and how many lists a query needs, from a sample in an order
    that says nothing about the vectors."""
    rows, random = _scaled(sample), np.random.default_rng(SEED)
    centroids = np.unique(rows[:wanted], axis=0)
    for _ in range(ROUNDS):
        own = _nearest_list(rows, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        order = np.argsort(own, kind="stable")
        used = counts > 0
        starts = (np.cumsum(counts) - counts)[used]
        centroids[used] = np.add.reduceat(rows[order], starts) / counts[used][:, None]
    own = _nearest_list(rows, centroids)
    ranks = []
    for i, query in enumerate(rows[:TRIED]):
        away = np.square(rows - query).sum(axis=1)
        away[i] = np.inf
        near = np.argsort(away, kind="stable")[:min(NEAREST, len(rows) - 1)]
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(_squared(query[None], centroids)[0], kind="stable")] = np.arange(
            len(centroids))
        ranks.append(place[own[near]])
    ranks = np.sort(np.concatenate(ranks))
    probes = int(ranks[int(np.ceil(FOUND * len(ranks))) - 1]) + 1 if len(ranks) else 1
    rotation = np.linalg.qr(random.normal(size=(sample.shape[1],) * 2))[0]
    return Space(rotation, centroids * (np.abs(sample).max() or 1.0), max(FIRST, probes),
                 np.zeros(len(centroids), np.int64))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def fit(rows: DataFrame) -> dict[int, Space]:
    """Length of vectors -> its space, for (vec_id, vector). From `SAMPLE` vectors at
    most, those with the smallest hashes, on the driver; every vector is indexed."""
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vector"), "vec_id").limit(SAMPLE).select(
        F.size("vector").alias("size"), "vector").toArrow()
    sizes, vectors = drawn["size"].to_numpy(), drawn["vector"].combine_chunks()
    spaces = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        share = n * len(own) / len(sizes)
        wanted = int(min(MOST_LISTS, share ** 0.5, share / LEAST_LIST, len(own)))
        sample = _matrix(vectors.take(pa.array(own)), size).astype(np.float64)
        spaces[size] = _space(sample, max(1, wanted))
    return spaces


def _dealt(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(size, list, vec_id, vector): every vector in the list of its nearest centroid.
    A length that the sample has not met is one list."""
    shared = rows.sparkSession.sparkContext.broadcast(
        {size: space.centroids for size, space in spaces.items()})
    kind = rows.schema["vector"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy()
            lists = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes).tolist():
                if size in shared.value:
                    own = np.flatnonzero(sizes == size)
                    vectors = _matrix(batch["vector"].take(pa.array(own)), size).astype(np.float64)
                    lists[own] = _nearest_list(vectors, shared.value[size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes.astype(np.int32)), pa.array(lists), batch["vec_id"], batch["vector"]],
                names=["size", "list", "vec_id", "vector"])

    return map_arrow(rows.select("vec_id", "vector"), work,
                     f"size int, list int, vec_id bigint, vector {kind}")


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding",
          k: int = NEAREST) -> Index:
    """The index over all usable rows of `vectors`.

    Rows that repeat id and vector are one. Of equal vectors, `k` + 1 with the smallest
    ids are kept: no query can be given more of them, and a vector that a third of all
    rows share does not fill a list. Long lists are cut into blocks by hash.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"),
                          F.col(column).alias("vector")).where(
        usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct()
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = written(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    spaces = fit(rows)
    dealt = written(_dealt(rows, spaces), "dealt")
    lengths = dealt.groupBy(F.col("size").alias("_size"), F.col("list").alias("_list")).agg(
        F.count("*").alias("length"))
    # One row per list of the spaces, so bounded.
    for size, number, length in lengths.where(F.col("_size").isin(list(spaces))).collect():
        spaces[size].lengths[number] = length
    values = F.col("length") * F.col("size")
    cut = dealt.join(lengths, (F.col("size") == F.col("_size")) & (F.col("list") == F.col("_list"))).select(
        "size", "list", F.pmod(F.xxhash64("vec_id"), F.ceil(values / MOST_VALUES)).cast("int").alias(
            "block"), "vec_id", "vector")
    shared = vectors.sparkSession.sparkContext.broadcast(
        {size: space.rotation for size, space in spaces.items()})

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size = table["size"][0].as_py()
        rows = _matrix(table["vector"].combine_chunks(), size)
        turned = _turned(rows, shared.value.get(size))
        columns = [np.ascontiguousarray(turned[:, at:at + COLUMNS].T).tobytes()
                   for at in range(0, size, COLUMNS)]
        return pa.table({"size": table["size"][:1], "list": table["list"][:1],
                         "block": table["block"][:1],
                         "ids": pa.array([table["vec_id"].to_numpy()], pa.list_(pa.int64())),
                         "columns": pa.array([columns], pa.list_(pa.binary())),
                         "vectors": pa.array([rows.tobytes()], pa.binary())})

    ship(vectors.sparkSession)
    return Index(spaces, written(cut.groupBy("size", "list", "block").applyInArrow(
        block, "size int, list int, block int, ids array<bigint>, columns array<binary>, "
               "vectors binary"), "blocks"))


def _turned(rows: np.ndarray, rotation: np.ndarray | None) -> np.ndarray:
    """In single precision: they only decide what is abandoned."""
    with np.errstate(over="ignore", invalid="ignore"):
        wide = rows.astype(np.float64)
        return (wide if rotation is None else wide @ rotation).astype(np.float32)


# Search

def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    found = np.empty(len(left))
    for part in _tiles(len(left), left.shape[1]):
        found[part] = np.sqrt(np.square(left[part].astype(np.float64) - right[part]).sum(axis=1))
    return found


def scan(queries: np.ndarray, turned: np.ndarray, beat: np.ndarray, rows: np.ndarray,
         columns: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of what may be among the `k` nearest of each query, at most
    as far as `beat`. `columns` are the rows turned, `COLUMNS` dimensions at a time.

    The distance to beat falls to the k-th smallest of those rows that look nearest in
    the first block. Then pairs are compared block by block; those that are left are
    measured in double precision.
    """
    size, n = queries.shape[1], len(rows)
    slack = 1e-10 * (np.square(turned, dtype=np.float64).sum(axis=1)
                     + max((np.square(rows[part], dtype=np.float64).sum(axis=1).max()
                            for part in _tiles(n, size)), default=0.0))
    partial = np.zeros((len(queries), n), np.float32)
    for j, column in enumerate(columns[0]):
        partial += np.square(turned[:, j, None] - column[None, :])
    if n > k:
        look = np.argpartition(partial, k - 1, axis=1)[:, :k]
        owner = np.repeat(np.arange(len(queries)), k)
        seen = _distances(queries[owner], rows[look.ravel()]).reshape(-1, k).max(axis=1)
        beat = np.minimum(beat, seen)

    def hopeless(away: np.ndarray, seen: int, square: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Whether the distance in `seen` dimensions rules a pair out; never if it is
        beyond single precision."""
        allowed = 1e-4 if seen == size else DOUBT / seen ** 0.5
        far = away.astype(np.float64) * (size / seen) > square * (1 + allowed) ** 2 + slack
        return far & np.isfinite(away)

    square = np.square(beat)
    seen = len(columns[0])
    query, row = np.nonzero(~hopeless(partial, seen, square[:, None], slack[:, None]))
    away = partial[query, row]
    for block in columns[1:]:
        for j, column in enumerate(block, seen):
            away += np.square(turned[query, j] - column[row])
        seen += len(block)
        left = ~hopeless(away, seen, square[query], slack[query])
        query, row, away = query[left], row[left], away[left]
    distance = _distances(queries[query], rows[row])
    left = distance <= beat[query]
    return query[left], row[left], distance[left]


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each query, ties to the smaller id."""
    order = np.lexsort((ids, distance, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


_FOUND = "q bigint, vec_id bigint, score double"


def _search(index: Index, probes: DataFrame, kind: str, k: int) -> DataFrame:
    """(q, vec_id, score) of the `k` nearest of each query in each block of the lists that
    it probes; `probes` is written: (q, size, list, vector, beat).

    A task takes one block of a list and at most `MOST_QUERIES` of its queries.
    """
    lists = index.blocks.groupBy("size", "list").agg((F.max("block") + 1).alias("blocks"))
    tiles = probes.groupBy("size", "list").agg(
        F.ceil(F.count("*") / MOST_QUERIES).cast("int").alias("tiles"))
    known = lists.join(tiles, ["size", "list"])
    left = index.blocks.join(known.drop("blocks"), ["size", "list"]).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    right = probes.join(known, ["size", "list"]).withColumn(
        "tile", F.pmod(F.xxhash64("q"), F.col("tiles")).cast("int")).drop("tiles").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dtype = np.float32 if kind == "array<float>" else np.float64
    shared = probes.sparkSession.sparkContext.broadcast(
        {size: space.rotation for size, space in index.spaces.items()})
    empty = pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                      "score": pa.array([], pa.float64())})

    def task(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(blocks) or not len(queries):
            return empty
        size = blocks["size"][0].as_py()
        ids = blocks["ids"].combine_chunks().flatten().to_numpy()
        rows = np.frombuffer(blocks["vectors"][0].as_buffer(), dtype).reshape(-1, size)
        columns = [np.frombuffer(c.as_buffer(), np.float32).reshape(-1, len(ids))
                   for c in blocks["columns"][0]]
        queries = queries.combine_chunks()
        number = queries["q"].to_numpy()
        vectors = _matrix(queries["vector"].combine_chunks(), size)
        beat, turned = queries["beat"].to_numpy(), _turned(vectors, shared.value.get(size))
        parts = [empty]
        for part in _tiles(len(number), len(ids)):
            with np.errstate(over="ignore", invalid="ignore"):
                query, row, distance = scan(vectors[part], turned[part], beat[part], rows, columns, k)
            own = _best(query, ids[row], distance, k)
            parts.append(pa.table({"q": number[part][query[own]], "vec_id": ids[row[own]],
                                   "score": distance[own]}))
        return pa.concat_tables(parts)

    ship(probes.sparkSession)
    keys = ("size", "list", "block", "tile")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, _FOUND)


def _probes(queries: DataFrame, spaces: dict[int, Space], k: int) -> DataFrame:
    """(q, size, list, place, vector): the lists of each query, the nearest first: as many
    as the space asks for, and more until they hold `k` vectors."""
    shared = queries.sparkSession.sparkContext.broadcast(spaces)
    kind = queries.schema["vector"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy()
            owner, lists, places = [], [], []
            for i, size in enumerate(sizes.tolist()):
                order = np.zeros(1, np.int64)
                if size in shared.value:
                    space = shared.value[size]
                    vector = batch["vector"][i].values.to_numpy().astype(np.float64)
                    order = np.argsort(_squared(vector[None], space.centroids)[0], kind="stable")
                    order = order[space.lengths[order] > 0]
                    held = np.cumsum(space.lengths[order])
                    order = order[:max(space.probes, int(np.searchsorted(held, k)) + 1)]
                owner.append(np.full(len(order), i))
                lists.append(order)
                places.append(np.arange(len(order)))
            if not owner:
                continue
            owner, lists, places = map(np.concatenate, (owner, lists, places))
            sent = batch.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [sent["q"], pa.array(sizes[owner].astype(np.int32)), pa.array(lists.astype(np.int32)),
                 pa.array(places.astype(np.int32)), sent["vector"]],
                names=["q", "size", "list", "place", "vector"])

    return map_arrow(queries.select("q", "vector"), work,
                     f"q bigint, size int, list int, place int, vector {kind}")


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    """(q, best): the `k` nearest of each query, in order; cut per task first."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))


def nearest(index: Index, queries: DataFrame, key: str = "vec_id", column: str = "embedding",
            k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest that the index finds for every
    usable row of `queries`, other than the row itself, ties to the smaller `vec_id`;
    `score` is the Euclidean distance in double precision.

    Equal queries are searched once, for `k` + 1. Two rounds: the `FIRST` nearest lists
    give each query a distance to beat, the others are scanned with it. A row is its own
    where id and vector are equal; another row under its id is a candidate. Vectors that
    are NULL, zero or hold a NULL or non-finite component, and rows with a NULL id, take
    no part; vectors of different lengths do not meet. Queries that repeat id and vector
    count once. Without queries, or without candidates, there are no rows.
    """
    kind = queries.schema[column].dataType.simpleString()
    rows = written(queries.select(F.col(key).cast("bigint").alias("query_id"),
                                  F.col(column).alias("vector")).where(
        usable(F.col("vector")) & F.col("query_id").isNotNull()).distinct(), "queries")
    classes = written(rows.select("vector").distinct().withColumn(
        "q", F.monotonically_increasing_id()), "query_classes")
    probes = written(_probes(classes, index.spaces, k + 1), "probes")

    begun = F.col("place") < FIRST
    first = written(_search(index, probes.where(begun).withColumn(
        "beat", F.lit(float("inf"))).drop("place"), kind, k + 1), "first")
    beat = _nearest_of(first, k + 1).where(F.size("best") == k + 1).select(
        F.col("q").alias("_q"), F.element_at("best", k + 1).score.alias("beat"))
    later = written(probes.where(~begun).join(beat, F.col("q") == F.col("_q"), "left").select(
        "q", "size", "list", "vector", F.coalesce("beat", F.lit(float("inf"))).alias("beat")), "later")
    second = written(_search(index, later, kind, k + 1), "second")

    best = _nearest_of(first.unionByName(second), k + 1)
    named = classes.withColumnRenamed("vector", "_vector").join(best, "q")
    own = rows.join(named, F.col("vector") == F.col("_vector")).select("query_id", F.slice(
        F.filter("best", lambda b: ~((b.vec_id == F.col("query_id")) & (b.score == 0))),
        1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"),
        F.col("b.score").alias("score"))
