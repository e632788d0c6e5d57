"""City demographics to `fact_demographics`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from portolan.functions.numbers import text_to
from portolan.operators.fact import Loss, corrupt_lines, count_losses
from portolan.operators.keys import dense_index
from portolan.schemas import CORRUPT, DEMOGRAPHICS

# Populations repeat on every race row of a city: the contract's whole numbers.
PER_CITY = [f.name for f in DEMOGRAPHICS if f.dataType.simpleString() == "int"]


def _typed(name: str, type_name: str) -> Column:
    return F.col(name) if type_name == "string" else text_to(F.col(name), type_name)


def project_demographics(raw: DataFrame) -> DataFrame:
    """Select and type the contract columns by name; a malformed number is NULL. `_lost`
    comes along, if there."""
    return raw.select(*[
        _typed(f.name, f.dataType.simpleString()).alias(f.name) for f in DEMOGRAPHICS],
        *[c for c in raw.columns if c == FLAGS])


NUMBERS = [(f.name, f.dataType.simpleString()) for f in DEMOGRAPHICS
           if f.dataType.simpleString() != "string"]
FLAGS = "_lost"


def _lost_number(name: str, kind: str) -> Column:
    return F.col(name).isNotNull() & _typed(name, kind).isNull()


def flag_losses(raw: DataFrame) -> DataFrame:
    """`raw` with `_lost`: which numbers of a row are lost in typing, as bits in their
    order, and after them whether its line did not parse."""
    faults = [_lost_number(name, kind) for name, kind in NUMBERS]
    faults.append(F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False))
    return raw.withColumn(FLAGS, reduce(Column.__add__, [
        F.when(fault, 1 << bit).otherwise(0) for bit, fault in enumerate(faults)]))


def flagged_losses(flagged: DataFrame) -> list[Loss]:
    """`demographics_losses` of typed rows that carry `_lost`."""
    bits = [name for name, _ in NUMBERS] + ([CORRUPT] if CORRUPT in flagged.columns else [])
    found = []
    for bit, name in enumerate(bits):
        rejected = F.count_if(F.col(FLAGS).bitwiseAND(1 << bit) != 0)
        present = F.lit(0) if name == CORRUPT else F.count(name)
        found.append(Loss(name, present + rejected, F.lit(0), rejected))
    return found


def without_flags(numbered: DataFrame) -> DataFrame:
    return numbered.drop(FLAGS)


def demographics_losses(raw: DataFrame) -> list[Loss]:
    """Per number column: texts present, and how many are no such number. An empty text
    reads as NULL and is no loss; a fraction in a whole-number column is one."""
    return [*[Loss(name, F.count(name), F.lit(0), F.count_if(_lost_number(name, kind)))
              for name, kind in NUMBERS], *corrupt_lines(raw)]


def demographics_rejects(raw: DataFrame) -> DataFrame:
    """The losses of `project_demographics`, and the lines that did not parse."""
    return count_losses(raw, demographics_losses(raw))


def build_demographics(raw: DataFrame) -> DataFrame:
    """Contract columns plus `demo_key`, numbered by state, city and race."""
    return dense_index(project_demographics(raw), ["state_code", "city", "race"], "demo_key",
                       from_files=True)


def state_populations(demographics: DataFrame) -> DataFrame:
    """State totals. Each city counts once, however many race rows it has."""
    cities = demographics.groupBy("state_code", "city").agg(
        *[F.max(c).alias(c) for c in PER_CITY])
    return cities.groupBy("state_code").agg(*[F.sum(c).alias(c) for c in PER_CITY])
