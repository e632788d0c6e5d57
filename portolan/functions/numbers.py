"""Numeric casts that give NULL, not an error, for what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_int(number: Column) -> Column:
    return number.try_cast("int")


def text_to(text: Column, type_name: str) -> Column:
    """Text to a number type; whole numbers may be written `3.0`, not `3.5`."""
    if type_name in ("int", "bigint"):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast(type_name))
    return text.try_cast(type_name)
