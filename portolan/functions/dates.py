"""Date expressions. None depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Day zero of the raw numeric dates, the two text layouts, and
# the mark for "no fixed leave date".
DAY_ZERO = "1960-01-01"
FILE_DATE_LAYOUT = "yyyyMMdd"
LEAVE_DATE_LAYOUT = "MMddyyyy"
NO_LEAVE_DATE = "D/S"

# Day numbers of 0001-01-01 and the day after 9999-12-31: what DATE can hold.
FIRST_DAY, END_DAY = -715509, 2936550


def sas_date(days: Column) -> Column:
    """Day number (fractions allowed, counted from 1960-01-01) to DATE.

    A fraction belongs to the day it falls in, so negative numbers floor too.
    NULL, NaN and numbers outside years 1..9999 give NULL.
    """
    whole = F.floor(days).try_cast("int")
    return F.when(
        (days >= FIRST_DAY) & (days < END_DAY),
        F.date_add(F.lit(DAY_ZERO).cast("date"), whole),
    )


# What each part of a text date may look like.
PARTS = {"yyyy": "(?!0000)[0-9]{4}", "MM": "(0[1-9]|1[0-2])", "dd": "(0[1-9]|[12][0-9]|3[01])"}


def text_date(text: Column, layout: str) -> Column:
    """Eight digits in `layout` to DATE; anything else, or no such day, is NULL.

    Match, cut and cast: no time zone is involved, and only days like 30 February
    get as far as a failing cast, which costs far more than a failing match.
    """
    shape = layout
    for part, digits in PARTS.items():
        shape = shape.replace(part, digits)
    year, month, day = (F.substring(text, layout.index(part) + 1, len(part)) for part in PARTS)
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    return F.when(text.rlike(rf"\A{shape}\z"), iso.try_cast("date"))


def file_date(text: Column) -> Column:
    return text_date(text, FILE_DATE_LAYOUT)


def leave_date(text: Column) -> Column:
    """The "no fixed date" mark is no date either."""
    return text_date(text, LEAVE_DATE_LAYOUT)
