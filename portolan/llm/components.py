"""Connected components of a graph held in a DataFrame, and within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from portolan.llm.common import written


def spanning_links(left: np.ndarray, right: np.ndarray, parent: list[int]) -> list[int]:
    """Places of the links (left[i], right[i]) that join what no link before joined: at
    most one less than there are nodes connect what all of them do.

    `parent` names for each node one that it is connected to, itself to begin with; it
    takes the links in, and can be handed on with further ones.
    """
    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def _stars(links: DataFrame, label: str) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are linked to
    the smallest node it knows. Links run from the larger node (a) to the smaller (b)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_b")).select(
        "_a", F.least("_a", "_b").alias("_least"))
    large = both.join(least, F.col("a") == F.col("_a")).where(
        (F.col("b") > F.col("a")) & (F.col("b") > F.col("_least"))).select(
        F.col("b").alias("a"), F.col("_least").alias("b")).distinct()
    large = written(large, label)
    lowest = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least"))
    small = large.join(lowest, F.col("a") == F.col("_a")).where(F.col("b") != F.col("_least")).select(
        F.col("b").alias("a"), F.col("_least").alias("b"))
    return written(small.unionByName(
        lowest.select(F.col("_a").alias("a"), F.col("_least").alias("b"))).distinct(), label)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for the nodes of `links` (a, b): `root` is the smallest node that a
    node reaches. Nodes are numbers; roots themselves are listed too.

    Alternating large and small stars: logarithmically many rounds, each a few
    shuffles of the links, written to the shared folder. Minima are combined before
    the shuffle and a hub's links join as a plain equi-join, which Spark splits.
    Nothing but two numbers per round reaches the driver.
    """
    links = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        sign = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == before or sign[0] == 0:
            break
        before, links = sign, _stars(links, label)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
