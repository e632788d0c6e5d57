"""The star-schema questions the tables are built for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from portolan.operators.demographics import state_populations
from portolan.operators.star import people_by, star_count, star_join


def entries_by_state_month_visa(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """People entering per state, month and visa type."""
    return star_count(fact, dims, ["state", "visa"], ["i94yr", "i94mon"])


def star_rollup(fact: DataFrame) -> DataFrame:
    """The same counts with subtotals; `level` 0 is the finest, 7 the grand total.

    The finest counts are made first, so ROLLUP copies counts, not entries.
    """
    finest = people_by(fact, ["state_code", "visa_key", "i94yr"])
    return finest.rollup("state_code", "visa_key", "i94yr").agg(
        F.sum("people").alias("people"),
        F.sum("entries").alias("entries"),
        F.grouping_id().cast("int").alias("level"),
    )


def top_destinations(fact: DataFrame, dims: dict[str, DataFrame], k: int) -> DataFrame:
    """The `k` states most people go to; equal counts go by code."""
    top = (
        people_by(fact.where(F.col("state_code").isNotNull()), ["state_code"])
        .orderBy(F.desc("people"), "state_code").limit(k)
    )
    return star_join(top, dims, ["state"])


def top_ports_per_visa(fact: DataFrame, dims: dict[str, DataFrame], k: int) -> DataFrame:
    """The `k` busiest ports of every visa type.

    The rank filter lets Spark cut each task to its own first `k` per visa type
    before the shuffle, so no task sees a whole group.
    """
    counted = people_by(fact.where(F.col("port_key").isNotNull()), ["visa_key", "port_key"])
    busiest = Window.partitionBy("visa_key").orderBy(F.desc("people"), "port_key")
    top = counted.withColumn("place", F.row_number().over(busiest)).where(F.col("place") <= k)
    return star_join(top, dims, ["visa", "port"])


def month_on_month(fact: DataFrame) -> DataFrame:
    """People per state and month, and the change from the calendar month before.

    NULL where the month before has no entries. The window runs over monthly
    counts: one row per state and month.
    """
    monthly = people_by(
        fact.where(F.col("i94yr").isNotNull() & F.col("i94mon").isNotNull()),
        ["state_code", "i94yr", "i94mon"])
    month_before = (
        Window.partitionBy("state_code").orderBy(F.col("i94yr") * 12 + F.col("i94mon"))
        .rangeBetween(-1, -1))
    before = F.sum("people").over(month_before)
    return monthly.select(
        "state_code", "i94yr", "i94mon", "people",
        before.alias("people_before"), (F.col("people") - before).alias("change"))


def entries_per_resident(fact: DataFrame, demographics: DataFrame) -> DataFrame:
    """People entering per 1000 residents of the state; NULL where residents are unknown.

    Both sides are brought to one row per state before they meet.
    """
    people = people_by(fact, ["state_code"])
    return people.join(state_populations(demographics), "state_code", "left").select(
        "state_code", "people", "total_population",
        F.try_divide(F.col("people") * 1000.0, "total_population").alias("per_thousand"))
