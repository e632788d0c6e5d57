"""Fact-to-dimension joins.

No side is broadcast by hint. Spark broadcasts a side only while its size,
estimated or measured at run time, is under `spark.sql.autoBroadcastJoinThreshold`
and otherwise sort-merges, splitting skewed partitions at run time.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F


class Link(NamedTuple):
    fact_key: str
    table: str
    table_key: str
    labels: dict[str, str]  # column of the dimension -> name in the result


# The keys that tie the fact to its dimensions.
LINKS = {
    "citizenship": Link("cit_region_key", "dim_country", "region_key",
                        {"region_name": "citizenship"}),
    "residence": Link("res_region_key", "dim_country", "region_key",
                      {"region_name": "residence"}),
    "port": Link("port_key", "dim_port", "port_key",
                 {"state": "port_state", "address": "port_address"}),
    "mode": Link("i94mode_key", "dim_i94_mode", "i94mode_key", {"i94mode": "i94mode"}),
    "state": Link("state_code", "dim_state", "state_code", {"state": "state"}),
    "visa": Link("visa_key", "dim_visa", "visa_key", {"visa_broad_type": "visa_broad_type"}),
    "time": Link("arrival_date", "dim_time", "arrival_date",
                 {c: c for c in ("day", "week", "month", "year", "weekday")}),
}

# The code list's own entry for "everything else".
OTHER_STATE = "99"


def star_join(fact: DataFrame, dims: dict[str, DataFrame], links: list[str],
              how: str = "left") -> DataFrame:
    """Add the labels of each link to the rows of `fact`."""
    joined = fact
    for name in links:
        link = LINKS[name]
        dim = dims[link.table].select(
            F.col(link.table_key).alias("_key"),
            *[F.col(column).alias(label) for column, label in link.labels.items()])
        joined = joined.join(dim, F.col(link.fact_key) == F.col("_key"), how).drop("_key")
    return joined


# The grain of the counts that are kept month by month.
COUNTED = ["i94yr", "i94mon", "arrival_date", "state_code", "visa_key"]


def people_by(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Entries and people per key, of a fact or of counts that hold the keys; partial
    sums run before the shuffle."""
    if "people" in fact.columns:
        people, entries = F.sum("people"), F.sum("entries")
    else:
        people, entries = F.sum("i94_count"), F.count("*")
    return fact.groupBy(*keys).agg(people.alias("people"), entries.alias("entries"))


def counts_of(fact: DataFrame) -> DataFrame:
    """The rows of `fact_counts`. What asks for no other key than `COUNTED` has gives the
    same from these as from the fact: `star_count`, `star_rollup`, `month_on_month`,
    `top_destinations`, `entries_per_resident`, `build_calendar`."""
    return people_by(fact, COUNTED)


def star_count(fact: DataFrame, dims: dict[str, DataFrame], links: list[str],
               by: list[str] | None = None, how: str = "left") -> DataFrame:
    """People and entries per linked dimension and extra fact column.

    Counted on the keys first; labels join the counts, never the entry rows.
    """
    keys = [LINKS[name].fact_key for name in links] + list(by or [])
    return star_join(people_by(fact, keys), dims, links, how)


def with_unknown_member(fact: DataFrame, states: DataFrame,
                        other: str = OTHER_STATE) -> DataFrame:
    """`state_code` as it is where the dimension knows it, else `other`.

    The dimension's keys must be unique, as its checks require. Nothing stands between
    shuffle and join, so Spark can split a state with most of the entries.
    """
    known = states.select(F.col("state_code").alias("_known"))
    columns = [F.coalesce("_known", F.lit(other)).alias(c) if c == "state_code" else F.col(c)
               for c in fact.columns]
    return fact.join(known, F.col("state_code") == F.col("_known"), "left").select(*columns)


def orphan_keys(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """(key, entries) of fact keys the dimension lacks; a missing key is no orphan.

    The anti join meets one row per key, not one per entry.
    """
    counted = fact.where(F.col(fact_key).isNotNull()).groupBy(
        F.col(fact_key).alias("key")).agg(F.count("*").alias("entries"))
    return counted.join(dim.select(F.col(dim_key).alias("key")), "key", "left_anti")


def orphan_report(fact: DataFrame, dims: dict[str, DataFrame], links: list[str]) -> DataFrame:
    """(fact_key, key, entries) of every linked dimension, keys as text.

    Each part reads one column of the fact, so together they read each once.
    """
    parts = []
    for name in links:
        link = LINKS[name]
        orphans = orphan_keys(fact, dims[link.table], link.fact_key, link.table_key)
        parts.append(orphans.select(F.lit(link.fact_key).alias("fact_key"),
                                    F.col("key").cast("string").alias("key"), "entries"))
    return reduce(DataFrame.unionByName, parts)
