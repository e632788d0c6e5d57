"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors. A vector is described by its
nearest pivots; vectors that are close share most of them. Every pivot has an inverted
list of the vectors near it; vectors that share two pivots meet in a list, and every
two that meet are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from portolan.llm.common import map_arrow, ship, written
from portolan.llm.components import components, spanning_links

COSINE = 0.95
NEAREST = 6                # pivots that describe a vector; two shared ones make a candidate
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
APART = 0.7                # cosine that two pivots stay below, seen from the middle of all
DRAWN = 4                  # vectors drawn for each pivot wanted
MOST_LIST = 20_000         # a longer list is worked on in blocks of this many
TILE = 1024


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not NULL, no missing or non-finite
    component, not all zero."""
    return F.coalesce(
        ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _spread(points: np.ndarray, most: int) -> np.ndarray:
    """The first `most` unit rows that have a cosine below `APART` with all before them.

    Directions are taken from the middle of the rows: where vectors all lean one way, as
    text embeddings do, any two of them have a high cosine from the origin, and only what
    is left without the common part tells them apart.
    """
    turned = points - points.mean(axis=0)
    lengths = np.linalg.norm(turned, axis=1, keepdims=True)
    turned = np.divide(turned, lengths, out=np.zeros_like(turned), where=lengths > 1e-12)
    kept, chosen = np.empty((min(most, len(points)), points.shape[1])), []
    for i, point in enumerate(turned):
        if len(chosen) == len(kept):
            break
        if not chosen or (kept[:len(chosen)] @ point).max() < APART:
            kept[len(chosen)] = point
            chosen.append(i)
    return points[chosen]


def draw_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Dimension -> pivots as unit rows, twice the square root of the number of vectors
    in all, `MOST_PIVOTS` at most.

    They come from `DRAWN` times as many vectors, those with the smallest hashes. One
    that is near another pivot is passed over: a dense cluster would get pivots in
    proportion to its rows, in an order about its vectors that only noise decides. So it
    shares one and the stable rest. Where the draw runs out, there are fewer pivots.
    """
    n = classes.count()
    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(2 * n ** 0.5)))
    drawn = classes.orderBy(F.xxhash64("vector"), "place").limit(DRAWN * most).select(
        F.size("vector").alias("size"), "vector").toArrow()
    sizes, vectors = drawn["size"].to_numpy(), drawn["vector"].combine_chunks()
    pivots = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        wanted = -(-most * len(own) // len(sizes))  # a dimension's share of the draw
        pivots[size] = _spread(unit_rows(_matrix(vectors.take(pa.array(own)))), wanted)
    return pivots


def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, in rising order; a tile of rows at a time."""
    k = min(NEAREST, len(points))
    near = np.empty((len(rows), k), np.int32)
    for at in range(0, len(rows), TILE):
        far = -(rows[at:at + TILE] @ points.T)
        near[at:at + TILE] = np.argsort(far, axis=1, kind="stable")[:, :k]
    return np.sort(near, axis=1)


def _list_entries(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(list, place, copies, near, vector): each vector under each pivot near it but
    the last, as a pair is looked for in the list of the smallest pivot it shares.

    A list belongs to a dimension and a pivot. Dimensions with fewer than two pivots
    have one list.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    schema = classes.schema
    ddl = (f"size int, pivot int, place bigint, copies bigint, near array<int>, "
           f"vector {schema['vector'].dataType.simpleString()}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch["vector"]])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                own = batch.take(pa.array(rows))
                points = shared.value.get(size, np.zeros((0, size)))
                if len(points) < 2:
                    near = np.zeros((len(rows), 1), np.int32)
                    taken, pivot = np.arange(len(rows)), near[:, 0]
                else:
                    near = _nearest(unit_rows(_matrix(own["vector"])), points)
                    taken = np.repeat(np.arange(len(rows)), near.shape[1] - 1)
                    pivot = near[:, :-1].ravel()
                sent = own.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(taken), size, np.int32)), pa.array(pivot), sent["place"],
                     sent["copies"], pa.array(list(near[taken]), pa.list_(pa.int32())),
                     sent["vector"]],
                    names=["size", "pivot", "place", "copies", "near", "vector"])

    return map_arrow(classes.select("place", "copies", "vector"), work, ddl)


def _in_blocks(entries: DataFrame, most: int = MOST_LIST) -> DataFrame:
    """`entries` plus (lower, upper, block): which two blocks of a list a task compares.

    A list of up to `most` vectors is one block. A longer one is cut by hash, and a
    vector sent to every pair of blocks with its own, so all its pairs are still met,
    by many tasks. Only long lists are in the table that joins: one row for `most`
    vectors or more, so it is small enough to broadcast.
    """
    lists = entries.groupBy(F.col("size").alias("_size"), F.col("pivot").alias("_pivot")).agg(
        F.count("*").alias("length")).where(F.col("length") > most)
    blocks = F.coalesce(F.ceil(F.col("length") / most), F.lit(1)).cast("int")
    joined = entries.join(
        F.broadcast(lists), (F.col("size") == F.col("_size")) & (F.col("pivot") == F.col("_pivot")),
        "left").withColumn("blocks", blocks)
    block = F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")
    return joined.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "size", "pivot", F.least("block", "other").alias("lower"),
        F.greatest("block", "other").alias("upper"), "block", "place", "copies", "near", "vector")


def _first_shared(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest pivots that each pair of rows shares (-1: none)."""
    shared = np.where((left[:, :, None] == right[:, None, :]).any(axis=2), left, 1 << 30)
    shared = np.sort(shared, axis=1)
    if shared.shape[1] < 2:
        return shared[:, 0], shared[:, 0]
    return shared[:, 0], shared[:, 1]


def _met(table: pa.Table, least: float) -> pa.Table:
    """What a pair of blocks of a list adds: per vector the rows it links with
    (`links`), and links enough to connect what is linked here (`other`).

    Vectors that share a second pivot are compared tile by tile. A pair is looked at
    under the two smallest pivots it shares and nowhere else, so it counts once.
    """
    pivot, lower, upper = (table[c][0].as_py() for c in ("pivot", "lower", "upper"))
    table = table.combine_chunks()
    place = table["place"].to_numpy()
    copies = table["copies"].to_numpy()
    block = table["block"].to_numpy()
    near = np.stack(table["near"].combine_chunks().flatten().to_numpy().reshape(len(place), -1))
    rows = unit_rows(_matrix(table["vector"].combine_chunks()))
    found = np.zeros(len(place), np.int64)
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    parent = list(range(len(place)))
    single = near.shape[1] == 1
    seconds = [-1] if single else np.unique(near[near > pivot]).tolist()
    for second in seconds:
        members = np.arange(len(place)) if single else np.flatnonzero((near == second).any(axis=1))
        if lower == upper:
            one = two = members
        else:
            one, two = members[block[members] == lower], members[block[members] == upper]
        for i in range(0, len(one), TILE):
            for j in range(i if lower == upper else 0, len(two), TILE):
                a, b = one[i:i + TILE], two[j:j + TILE]
                left, right = np.nonzero(rows[a] @ rows[b].T >= least)
                left, right = a[left], b[right]
                own = left < right if lower == upper else np.ones(len(left), bool)
                left, right = left[own], right[own]
                if not single:
                    first, next_ = _first_shared(near[left], near[right])
                    here = (first == pivot) & (next_ == second)
                    left, right = left[here], right[here]
                np.add.at(found, left, copies[right])
                np.add.at(found, right, copies[left])
                kept = spanning_links(left, right, parent)
                lefts.append(left[kept])
                rights.append(right[kept])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    linked = np.flatnonzero(found)
    return pa.table({
        "place": np.concatenate((place[linked], place[left])),
        "links": np.concatenate((found[linked], np.zeros(len(left), np.int64))),
        "other": pa.array(np.concatenate((np.zeros(len(linked), np.int64), place[right])),
                          mask=np.arange(len(linked) + len(left)) < len(linked))})


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding",
                    least: float = COSINE, most_list: int = MOST_LIST) -> DataFrame:
    """(place, n_links, component) of each row: `place` its number in `key`, `n_links`
    how many other rows' vectors have a cosine of `least` or more with its own, as far
    as the index finds them, `component` the smallest number it reaches by links.

    Every row is indexed. Equal vectors are one class, counted before the shuffle;
    only classes are compared, and a class's rows link with each other. No pair is
    ever sent: a task sends counts, and links enough to connect what it found. A vector
    without a direction (see `usable`) links with nothing; vectors of different lengths
    do not link. A row with a NULL number counts as a row but gives a component no
    name. Repeated rows are rows; an empty table gives no rows.
    """
    rows = written(vectors.select(
        F.col(key).cast("bigint").alias("place"),
        F.when(usable(F.col(column)), F.col(column)).alias("vector")), "vectors")
    classes = written(rows.where("vector IS NOT NULL").groupBy("vector").agg(
        F.min("place").alias("least"), F.count("*").alias("copies")).withColumn(
        "place", F.monotonically_increasing_id()), "classes")
    entries = written(_list_entries(classes, draw_pivots(classes)), "lists")
    ship(vectors.sparkSession)
    met = written(
        _in_blocks(entries, most_list).groupBy("size", "pivot", "lower", "upper").applyInArrow(
            lambda table: _met(table, least), "place bigint, links bigint, other bigint"), "met")
    found = written(components(met.where("other IS NOT NULL").select(
        F.col("place").alias("a"), F.col("other").alias("b"))), "found")
    links = met.groupBy(F.col("place").alias("_place")).agg(F.sum("links").alias("links"))
    least_of = classes.select("place", "least")
    named = found.join(least_of, F.col("node") == F.col("place")).groupBy(
        F.col("root").alias("_root")).agg(F.min("least").alias("linked"))
    linked = found.join(named, F.col("root") == F.col("_root")).select("node", "linked")
    known = (
        classes.join(links, F.col("place") == F.col("_place"), "left")
        .join(linked, F.col("place") == F.col("node"), "left")
        .select(F.col("vector").alias("_vector"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("linked", "least").alias("component"))
    )
    return rows.join(known, F.col("vector") == F.col("_vector"), "left").select(
        "place", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "place").alias("component"))
