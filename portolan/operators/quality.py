"""Checks on published tables: one aggregation per table, one row per check."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, functions as F


class Check(NamedTuple):
    name: str
    measure: Column                       # aggregate over the table
    holds: Callable[[Column], Column]     # verdict on the measured value
    fault: str                            # what to say when it does not hold


class QualityError(RuntimeError):
    """At least one check failed; the message lists every one."""


def year_not_future(as_of: datetime.date) -> Check:
    return Check("entry_year_not_future", F.max("i94yr"), lambda v: v <= as_of.year,
                 "entries from a year to come")


def no_nulls(column: str) -> Check:
    return Check(f"{column}_not_null", F.count_if(F.col(column).isNull()), lambda v: v == 0,
                 f"{column} is missing in some rows")


def unique(column: str) -> Check:
    """A key that occurs twice would double the entries that join it."""
    return Check(f"{column}_unique", F.count(column) - F.count_distinct(column),
                 lambda v: v == 0, f"{column} occurs more than once")


def checks_for(table: str, as_of: datetime.date) -> list[Check]:
    """Every table must hold rows; most have one check more."""
    return {
        "fact_i94": [year_not_future(as_of)],
        "dim_time": [no_nulls("arrival_date")],
        **{name: [no_nulls(key), unique(key)] for name, key in DIMENSION_KEYS.items()},
    }.get(table, [])


# The key column of each label dimension.
DIMENSION_KEYS = {"dim_port": "port_key", "dim_country": "region_key",
                  "dim_i94_mode": "i94mode_key", "dim_state": "state_code",
                  "dim_visa": "visa_key"}


def measures(checks: list[Check]) -> list[Column]:
    """One aggregate for the rows (`rows`) and one per check (`m0`, `m1`, ...)."""
    return [F.count("*").alias("rows"), *[
        check.measure.cast("bigint").alias(f"m{i}") for i, check in enumerate(checks)]]


def check_table(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """Report rows (table_name, check_name, passed, value, detail).

    An empty table fails `not_empty`; its other checks have no verdict.
    """
    return report_of(df.agg(*measures(checks)), table, checks)


def report_of(measured: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """The report rows from one row of `measures`, however it was come by."""
    rows = F.col("rows")
    lines = [_line(table, "not_empty", rows > 0, rows, "the table is empty")]
    for i, check in enumerate(checks):
        value = F.col(f"m{i}")
        holds = F.coalesce(check.holds(value), F.lit(False))
        lines.append(_line(table, check.name, F.when(rows > 0, holds), value, check.fault))
    return measured.select(F.inline(F.array(*lines)))


def _line(table: str, name: str, passed: Column, value: Column, fault: str) -> Column:
    detail = F.when(passed, "passed").when(~passed, fault).otherwise(
        "not evaluated: the table is empty")
    return F.struct(
        F.lit(table).alias("table_name"), F.lit(name).alias("check_name"),
        passed.alias("passed"), value.alias("value"), detail.alias("detail"))


def today() -> datetime.date:
    """Today in UTC, wherever the driver runs."""
    return datetime.datetime.now(datetime.UTC).date()


def quality_report(tables: dict[str, DataFrame], as_of: datetime.date | None = None) -> DataFrame:
    """The checks of every table given, in one report."""
    as_of = as_of or today()
    return reduce(DataFrame.unionByName, [
        check_table(df, name, checks_for(name, as_of)) for name, df in tables.items()])


def gate(report: DataFrame) -> list[Row]:
    """The report's rows, a few whatever the data; raise if a check failed."""
    rows = report.collect()
    refuse(rows)
    return rows


def refuse(rows: list[Row]) -> None:
    failed = [r for r in rows if r.passed is False]
    if failed:
        raise QualityError("; ".join(
            f"{r.table_name}.{r.check_name}: {r.detail} (value {r.value})" for r in failed))
