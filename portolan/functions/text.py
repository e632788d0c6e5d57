"""Text expressions for identifiers, labels and column headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def whole_id(text: Column) -> Column:
    """Drop one trailing `.0` that a float round trip left on an identifier."""
    return F.when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)


def plain_text(text: Column) -> Column:
    """Doubled quotes out, tabs and line ends to blanks, no blanks around."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("''"), F.lit("")), r"[\t\r\n]", " "))


def words(text: Column) -> Column:
    """Alphanumeric words in order; anything else separates them."""
    return F.split(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " ")


def header_name(name: str) -> str:
    """`Foreign-born` -> `foreign_born`. Works on a column name, not on data."""
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")
