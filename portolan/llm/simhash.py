"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

A fingerprint is one or more bands of bits. Two values of a band that differ in at most
`radius` bits share a variant: a value that differs from each of them in at most half
as many. Every value stands for all its variants, variants are dealt to buckets, and
fingerprints that meet in a variant are verified by all their bits and linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from portolan.llm.common import map_arrow, ship, written
from portolan.llm.components import components, spanning_links

SEED = 42
LEAST_GROUPS, MOST_GROUPS = 8, 30
VARIANTS_PER_BUCKET = 1 << 21


class Scheme(NamedTuple):
    """How texts are fingerprinted and when fingerprints link."""

    shingle: int        # words in a shingle
    bands: int          # a pair is looked for in each band
    width: int          # bits of a band, 64 at most
    radius: int         # a band's bits that a pair to be found may differ in
    most: int           # bits of the whole fingerprint that linked ones may differ in


# One band of 64 bits: every pair within 4 bits is found.
CLOSE = Scheme(shingle=4, bands=1, width=64, radius=4, most=4)


# Fingerprints

def shingles(text: str, scheme: Scheme = CLOSE) -> list[bytes]:
    """The shingles of a text, in order; one with fewer words than a shingle is one, one
    without words has none."""
    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined, count = b" ".join(words), max(1, len(words) - scheme.shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:count].tolist()
    return [joined[s:e] for s, e in zip(starts, ends[-count:].tolist())]


def fingerprint(text: str, scheme: Scheme = CLOSE) -> list[int]:
    """The bands of a text. A bit is set if it is set in over half of the shingles'
    hashes, repeats included; without words, none is."""
    found = shingles(text, scheme)
    if not found:
        return [0] * scheme.bands
    count, bits = len(found), scheme.bands * scheme.width
    if bits <= 64:
        digest = np.array([xxhash.xxh64_intdigest(s, SEED) for s in found],
                          "<u8").view(np.uint8).reshape(count, -1)
    else:
        digest = np.concatenate([
            np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, SEED + part) for s in found]),
                          np.uint8).reshape(count, -1)
            for part in range(-(-bits // 128))], axis=1)
    ones = np.zeros(digest.shape[1] * 8, np.int64)
    for at in range(0, count, 1 << 14):
        ones += np.unpackbits(digest[at:at + (1 << 14)], axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    is_set = (2 * ones > count)[:bits].reshape(scheme.bands, scheme.width)
    padded = np.zeros((scheme.bands, 64), bool)
    padded[:, :scheme.width] = is_set
    return np.packbits(padded, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, key: str, scheme: Scheme = CLOSE) -> DataFrame:
    """(place, print) of each row's text under its number in column `key`: the bands as
    signed numbers. A NULL text is an empty one."""
    schema = pa.schema([("place", pa.int64()), ("print", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py() or "", scheme) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["place"], pa.array(prints, pa.list_(pa.int64()))], schema=schema)

    return map_arrow(docs.select(F.col(key).cast("bigint").alias("place"), "text"), work,
                     "place bigint, print array<bigint>")


# Buckets
#
# Bit i of a band belongs to group i mod g. A value's bucket is the parities of its g
# groups, so a value's variants fall into few buckets: 1 + g for half the radius 1, and
# g (g - 1) / 2 more for 2. The fingerprint is sent to each of them once, and the task
# there makes the variants that belong to it: the shuffle on variants without sending
# them one by one.

def _masks(groups: int, width: int) -> list[int]:
    return [sum(1 << b for b in range(g, width, groups)) for g in range(groups)]


def _flips(groups: int, half: int, width: int) -> dict[int, np.ndarray]:
    """Change of bucket -> the bit flips of at most `half` bits that make it."""
    flips: dict[int, list[int]] = {}
    for n in range(half + 1):
        for bits in combinations(range(width), n):
            change = flip = 0
            for bit in bits:
                change ^= 1 << bit % groups
                flip |= 1 << bit
            flips.setdefault(change, []).append(flip)
    return {change: np.array(own, np.uint64) for change, own in flips.items()}


def _home(value: Column, groups: int, width: int) -> Column:
    bucket = F.lit(0)
    for g, mask in enumerate(_masks(groups, width)):
        signed = mask - ((mask >> 63) << 64)
        odd = F.bit_count(value.bitwiseAND(F.lit(signed).cast("bigint"))) % 2
        bucket = bucket.bitwiseOR(F.shiftleft(odd.cast("int"), g))
    return bucket


def _parities(values: np.ndarray, groups: int, width: int) -> np.ndarray:
    buckets = np.zeros(len(values), np.int64)
    for g, mask in enumerate(_masks(groups, width)):
        buckets |= (np.bitwise_count(values & np.uint64(mask)).astype(np.int64) & 1) << g
    return buckets


def _variants(own: np.ndarray, change: np.ndarray, flips: dict[int, np.ndarray]):
    """(value, owner) of all variants in one bucket, sorted by value."""
    values, owners = [], []
    for c in np.unique(change).tolist():
        those = np.flatnonzero(change == c)
        values.append((own[those][:, None] ^ flips[c][None, :]).ravel())
        owners.append(np.repeat(those, len(flips[c])))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value, kind="stable")
    return value[order], owner[order]


def _meet(prints: np.ndarray, value: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """Pairs of places in `prints` that meet in a variant and are within `most` bits:
    enough to connect all that are.

    Neighbours in a variant are tried, then those one further, and so on, as long as
    a variant holds some that are not connected yet.
    """
    found, parent = [np.zeros((0, 2), np.int64)], list(range(len(prints)))
    for step in range(1, len(prints)):
        same = value[step:] == value[:len(value) - step]
        if not same.any():
            break
        pair = np.unique(owner[:len(owner) - step][same] * len(prints) + owner[step:][same])
        left, right = np.divmod(pair, len(prints))
        bits = np.bitwise_count(prints[left] ^ prints[right]).sum(axis=1, dtype=np.int64)
        near = (bits <= most) & (left != right)
        left, right = left[near], right[near]
        kept = spanning_links(left, right, parent)
        found.append(np.stack((left[kept], right[kept]), axis=1))
        root = np.array(parent)
        while (root[root] != root).any():
            root = root[root]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        roots = root[owner]
        apart = np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)
        open_ = np.repeat(apart, np.diff(np.append(first, len(value))))
        value, owner = value[open_], owner[open_]
        if not len(value):
            break
    return np.concatenate(found)


def links(prints: DataFrame, scheme: Scheme = CLOSE,
          per_bucket: int = VARIANTS_PER_BUCKET) -> DataFrame:
    """(a, b) pairs of `id` whose prints link: enough of them to connect all that meet,
    at most one less per bucket than it has prints.

    `prints` (id, print) has no print twice. The number of buckets grows with it, so a
    bucket's variants fit a task; near prints differ in their parities, so a cluster
    spreads over the buckets like anything else.
    """
    half = scheme.radius // 2
    variants = sum(1 for k in range(half + 1) for _ in combinations(range(scheme.width), k))
    needed = (prints.count() * variants // per_bucket).bit_length()
    groups = min(MOST_GROUPS, scheme.width, max(LEAST_GROUPS, needed))
    flips = _flips(groups, half, scheme.width)
    home = _home(F.col("value"), groups, scheme.width)
    changes = F.array(*[F.lit(c) for c in sorted(flips)])
    sent = (
        prints.select("id", "print", F.posexplode("print").alias("band", "value"))
        .select("id", "print", "band", home.alias("home"))
        .select("id", "print", "band", F.explode(F.transform(
            changes, lambda change: F.col("home").bitwiseXOR(change))).alias("bucket"))
    )

    def meet(table: pa.Table) -> pa.Table:
        band, bucket = table["band"][0].as_py(), table["bucket"][0].as_py()
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        own = table["print"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(
            len(ids), -1)
        change = _parities(own[:, band], groups, scheme.width) ^ bucket
        pairs = ids[_meet(own, *_variants(own[:, band], change, flips), scheme.most)]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    ship(prints.sparkSession)
    return sent.groupBy("band", "bucket").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", scheme: Scheme = CLOSE) -> DataFrame:
    """(place, print, component) of each row: `place` its number in column `key`,
    `component` the smallest one among the rows it is linked to, directly or not.

    Fingerprints are written; all further work is on distinct ones. Equal texts meet
    in one fingerprint, counted together before the shuffle; rows take their component
    in an equi-join on the fingerprint, which Spark splits where one is common. Rows
    without words share a fingerprint of zeros and are linked like any other. A row
    with a NULL number belongs to its component without naming it (NULL if no row of
    it has a number). Repeated rows share a component; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, key, scheme), "fingerprints")
    distinct = written(prints.groupBy("print").agg(F.min("place").alias("least")).withColumn(
        "id", F.monotonically_increasing_id()), "distinct")
    found = written(components(links(distinct.select("id", "print"), scheme)), "found")
    member = found.join(distinct.select("id", "least"), F.col("node") == F.col("id"))
    named = member.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("linked"))
    linked = found.join(named, F.col("root") == F.col("_root")).select("node", "linked")
    known = distinct.join(linked, F.col("id") == F.col("node"), "left").select(
        F.col("print").alias("_print"), F.coalesce("linked", "least").alias("component"))
    return prints.join(known, F.col("print") == F.col("_print")).select("place", "print", "component")


def hex_digits(band: Column) -> Column:
    return F.lower(F.lpad(F.hex(band), 16, "0"))


def one_of_each(docs: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """The rows of `docs` with one row per component, all columns: the one with the
    smallest `doc_id`, or the first in the input of those that share it.

    Rows are told apart by their number in that order, so repeated ids and rows leave
    one row as well. What goes is written as a list of numbers: while that is under
    Spark's broadcast limit, the texts are not shuffled to take it out.
    """
    rows = written(docs.select(F.struct("*").alias("row"),
                               F.monotonically_increasing_id().alias("n")), "rows")
    texts = rows.select("n", F.col("row.text").alias("text"))
    found = written(near_duplicates(texts, "n", scheme).select(
        F.col("place").alias("n"), "component"), "near")
    doc_id = F.col("row.doc_id").cast("bigint")
    first = rows.select("n", doc_id.alias("doc_id")).join(found, "n").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("first"))
    gone = written(found.select("n").join(
        first.select(F.col("first.n").alias("n")), "n", "left_anti"), "gone")
    return rows.join(gone, "n", "left_anti").select("row.*")
