"""Raw entries to `fact_i94`: one narrow projection, no shuffle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from portolan.functions.dates import NO_LEAVE_DATE, file_date, leave_date, sas_date
from portolan.functions.numbers import to_int
from portolan.functions.text import whole_id
from portolan.schemas import CORRUPT, FACT_COLUMNS, LOST_VALUES

CONVERSIONS = {
    "int": to_int,
    "text": lambda column: column,
    "sas_date": sas_date,
    "file_date": file_date,
    "leave_date": leave_date,
    "whole_id": whole_id,
}


def build_fact(raw: DataFrame) -> DataFrame:
    """Rename, select and type the 23 published columns in one `select`."""
    return raw.select(
        *[CONVERSIONS[kind](F.col(source)).alias(name) for name, source, kind in FACT_COLUMNS])


def build_fact_and_rejects(raw: DataFrame) -> DataFrame:
    """`build_fact` plus `rejected`: (column_name, raw) of the values that typing lost, in
    column order, NULL where it lost none. The whole line counts, if it did not parse."""
    lost = [F.when(_rejected(F.col(source), kind), _lost(name, source))
            for name, source, kind in FACT_COLUMNS if kind not in ("text", "whole_id")]
    if CORRUPT in raw.columns:
        lost.append(F.when(F.col(CORRUPT).isNotNull(), _lost(CORRUPT, CORRUPT)))
    found = F.array_compact(F.array(*lost))
    return raw.select(
        *[CONVERSIONS[kind](F.col(source)).alias(name) for name, source, kind in FACT_COLUMNS],
        F.when(F.size(found) > 0, found).cast(LOST_VALUES).alias("rejected"))


def _lost(name: str, source: str) -> Column:
    return F.struct(F.lit(name).alias("column_name"), F.col(source).cast("string").alias("raw"))


def side_by_side(fact_and_rejects: DataFrame) -> DataFrame:
    """Each row under `table` = fact_i94 and, if it lost values, under entry_rejects once
    more: what one write deals to two tables. Only the latter carry `rejected`."""
    both = F.when(F.col("rejected").isNotNull(), F.array(F.lit("fact_i94"), F.lit("entry_rejects"))).otherwise(
        F.array(F.lit("fact_i94")))
    return fact_and_rejects.withColumn("table", F.explode(both)).withColumn(
        "rejected", F.when(F.col("table") == "entry_rejects", F.col("rejected")))


def reject_rows(rejects: DataFrame) -> DataFrame:
    """(i94_key, i94yr, i94mon, column_name, raw): a row per lost value."""
    return rejects.select("i94_key", "i94yr", "i94mon", F.inline("rejected"))


class Loss(NamedTuple):
    """What typing a column can lose: aggregates over the raw rows."""

    column: str
    present: Column
    no_date_mark: Column
    rejected: Column


def loss_measures(raw: DataFrame) -> list[Loss]:
    """The losses of every typed column; CSV input adds the lines that did not parse."""
    return [*[_loss(name, F.col(source), kind) for name, source, kind in FACT_COLUMNS
              if kind not in ("text", "whole_id")], *corrupt_lines(raw)]


def corrupt_lines(raw: DataFrame) -> list[Loss]:
    bad = F.count(CORRUPT)
    return [Loss(CORRUPT, bad, F.lit(0), bad)] if CORRUPT in raw.columns else []


def losses_of(measured: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, present, no_date_mark, rejected) from one row of measures p0, m0,
    r0, p1, ... in the order of `names`."""
    return measured.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"p{i}").alias("present"),
                 F.col(f"m{i}").alias("no_date_mark"), F.col(f"r{i}").alias("rejected"))
        for i, name in enumerate(names)])))


def named_measures(losses: list[Loss]) -> list[Column]:
    return [measure.cast("bigint").alias(f"{letter}{i}") for i, loss in enumerate(losses)
            for letter, measure in zip("pmr", loss[1:])]


def count_losses(raw: DataFrame, losses: list[Loss]) -> DataFrame:
    return losses_of(raw.agg(*named_measures(losses)), [loss.column for loss in losses])


def reject_counts(raw: DataFrame) -> DataFrame:
    """Per typed column: raw values present, and how many the typing lost.

    One aggregation over the raw rows, unfolded into (column_name, present,
    no_date_mark, rejected). The "no fixed leave date" mark is not a loss and
    has its own count. CSV input adds a row for lines that did not parse.
    """
    return count_losses(raw, loss_measures(raw))


def _loss(name: str, source: Column, kind: str) -> Loss:
    return Loss(name, F.count(source), F.count_if(_mark(source, kind)),
                F.count_if(_rejected(source, kind)))


def _mark(source: Column, kind: str) -> Column:
    return source == NO_LEAVE_DATE if kind == "leave_date" else F.lit(False)


def _rejected(source: Column, kind: str) -> Column:
    return source.isNotNull() & CONVERSIONS[kind](source).isNull() & ~_mark(source, kind)
