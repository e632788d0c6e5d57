"""`dim_time`: one row per distinct arrival date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def build_calendar(fact: DataFrame) -> DataFrame:
    """Distinct first, parts after: the shuffle carries one date per day and task.

    Built from the typed fact, or from counts that hold its arrival dates, so the raw
    source is not scanned again. An entry without an arrival date has no calendar row.
    """
    day = F.col("arrival_date")
    return (
        fact.select(day).where(day.isNotNull()).distinct()
        .select(
            day,
            F.dayofmonth(day).alias("day"),
            F.weekofyear(day).alias("week"),
            F.month(day).alias("month"),
            F.year(day).alias("year"),
            F.dayofweek(day).alias("weekday"),
        )
    )


def changed_years(published: DataFrame, calendar: DataFrame) -> list[int]:
    """The years in which one of two calendars has a date that the other lacks. A row per
    date on both sides; the driver takes a number per year."""
    old, new = (c.select("arrival_date", "year") for c in (published, calendar))
    changed = old.join(new, "arrival_date", "left_anti").unionByName(
        new.join(old, "arrival_date", "left_anti"))
    return sorted(r.year for r in changed.select("year").distinct().collect())
