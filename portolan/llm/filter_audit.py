"""How filters interact, for every order in which they could be applied.

A document fails a set of filters. In an order of the filters it is removed by the first
one that it fails. Orders are numbered by their Lehmer rank, lexicographically, so those
that begin alike are an interval of ranks; the orders in which a set of failures removes
at a step are a few intervals. Counts of documents are added where an interval begins and
taken off where it ends; running sums over the ranks give what every order removes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from portolan.llm.common import map_arrow, written

FILTERS = "ABCDE"
LEAST_WORDS = 200           # A
LEAST_DISTINCT = 50         # B: of a hundred words
MOST_CAPITALS = 2           # C: of a hundred characters
_COPY = 1 << FILTERS.index("E")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"          # D
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a character in UTF-8


def own_failures(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits."""
    words = text.split()  # on bytes: ASCII white space only
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return sum(fails << bit for bit, fails in enumerate((
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * len(text.translate(None, _LATER_BYTES)),
        len(text.translate(None, _MARKS)) < len(text))))


def orders(n: int) -> list[tuple[int, ...]]:
    """All orders of n filters by rank."""
    return list(permutations(range(n)))


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): documents that fail the filters in `mask` are removed at
    `step` (from 1) by the orders of the ranks from `first` on and before `end`.

    At a step, the choice of a filter is a digit of the rank, worth the factorial of how
    many are left after it. One that the document passes goes on to the next step; one
    that it fails removes it, whatever comes after: an interval of that factorial's
    length. Intervals that touch are one. n filters have n! ranks and 2^n masks, so the
    table is small for any number of filters whose orders can be listed at all.
    """
    found = []
    for mask in range(1, 1 << n):
        spans: dict[int, list[list[int]]] = {}

        def walk(left: list[int], step: int, rank: int) -> None:
            width = factorial(len(left) - 1)
            for digit, chosen in enumerate(left):
                first = rank + digit * width
                if not mask >> chosen & 1:
                    walk(left[:digit] + left[digit + 1:], step + 1, first)
                    continue
                own = spans.setdefault(step, [])
                if own and own[-1][1] == first:
                    own[-1][1] = first + width
                else:
                    own.append([first, first + width])

        walk(list(range(n)), 1, 0)
        found += [(mask, step, *span) for step, own in sorted(spans.items()) for span in own]
    return found


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, high, low) of each row: the filters A to D that its text
    fails and the 128-bit digest of the text. One narrow pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()),
                        ("high", pa.int64()), ("low", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, high, low = [], [], []
            for text in batch["text"]:
                raw = text.as_buffer().to_pybytes()
                fails.append(own_failures(raw))
                first, second = struct.unpack("<qq", hashlib.blake2b(raw, digest_size=16).digest())
                high.append(first)
                low.append(second)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], pa.array(fails, pa.int32()),
                 pa.array(high, pa.int64()), pa.array(low, pa.int64())], schema=schema)

    return map_arrow(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text")), work,
        "doc_id bigint, part string, fails int, high bigint, low bigint")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the
    filters in `mask`, and how many of those are labelled good and toxic.

    Filter E asks whether a smaller doc_id holds the same text. Of equal texts (which
    fail A to D alike) all rows fail it but those of the smallest id. So rows are counted
    before every shuffle, and a text that a third of all rows share is a few counts;
    texts themselves are never shuffled.
    """
    rows = failures(docs).groupBy("doc_id", "part", "fails", "high", "low").agg(
        F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("_doc_id"),
                          (F.col("quality") == 1).alias("_good"),
                          (F.col("toxic") == 1).alias("_toxic")).groupBy("_doc_id").agg(
        F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    known = rows.join(marks, F.col("doc_id") == F.col("_doc_id"), "left").select(
        "doc_id", "part", "fails", "high", "low", "n",
        F.coalesce("_good", F.lit(False)).alias("good"),
        F.coalesce("_toxic", F.lit(False)).alias("toxic"))
    named = F.col("doc_id").isNotNull()
    texts = known.groupBy("high", "low", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("high", "low"))
    single = F.col("unnamed") + F.when(
        F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    parted = texts.withColumn("smallest", smallest).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("fails").alias("mask"), F.coalesce(single, F.lit(0)).alias("n")),
            F.struct(F.col("fails").bitwiseOR(_COPY).alias("mask"),
                     (F.col("n") - F.coalesce(single, F.lit(0))).alias("n")))))
    return parted.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table that depends on the number of filters alone, so its size is known."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def totals(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for a written table of `cells`: 5 x 120 rows a part."""
    spark, n = counted.sparkSession, len(filters)
    ranked = orders(n)
    spans = _fixed(spark, removal_intervals(n), "_mask int, step int, first int, end int")
    names = _fixed(spark, [(rank, "".join(filters[f] for f in order))
                           for rank, order in enumerate(ranked)], "_rank int, filter_order string")

    counts = ("n", "good", "toxic")
    edges = counted.join(spans, F.col("mask") == F.col("_mask")).select(
        "part", "step", F.inline(F.array(
            F.struct(F.col("first").alias("rank"), *counts),
            F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in counts]))))
    # Every rank of every part is a row, also where no interval begins or ends.
    grid = counted.select("part").distinct().select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ranked) - 1))).alias("rank"),
        *[F.lit(0).cast("bigint").alias(c) for c in counts])
    ends = edges.unionByName(grid).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in counts])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    removed = ends.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in counts])

    fails = counted.select("part", "mask", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(1 << bit).alias("bit"))
        for bit, name in enumerate(filters)])).alias("filter")).groupBy(
        F.col("part").alias("_part"), F.col("filter.name").alias("_name")).agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("filter.bit")) != 0, F.col("n"))
              .otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("mask") == F.col("filter.bit"), F.col("n")).otherwise(0)).alias("alone"))

    named = removed.join(names, F.col("rank") == F.col("_rank")).withColumn(
        "name", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return named.join(fails, (F.col("part") == F.col("_part")) & (F.col("name") == F.col("_name"))).select(
        "part", "filter_order", "step",
        (F.col("documents") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"), (F.col("failing") - F.col("n")).alias("redundant"),
        F.col("alone").alias("unique_fails"), F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "name")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes from each part of `docs` (`doc_id`, `text`, `source`), at
    each step of each order of the filters; see `totals`.

    A NULL text is an empty one, so it fails A and is a copy of other empty texts. A
    NULL source is the part of the empty string. Texts are equal if their 128-bit
    digests are. A row with a NULL doc_id is no copy and makes none; rows that repeat an
    id and its text count each and are no copies of each other. A document is good or
    toxic if any row of `labels` says so; ids without labels are neither. Texts of any
    length are read whole, one at a time. Other columns are not touched; no documents
    give no rows.
    """
    return totals(written(cells(docs, labels), "cells"))
