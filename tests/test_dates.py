import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from portolan.functions.dates import FIRST_DAY, END_DAY, file_date, leave_date, sas_date
from portolan.functions.text import whole_id
from portolan.functions.numbers import text_to, to_int


@pytest.fixture(params=["UTC", "America/New_York", "Pacific/Apia"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def through(spark, values, kind, *functions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", *[f(F.col("v")).alias(f"c{n}") for n, f in enumerate(functions)])
    return [tuple(r)[1:] if len(functions) > 1 else r[1] for r in rows.orderBy("i").collect()]


def test_sas_date(spark, zone):
    days = [20573.0, 20573.9, 0.0, -0.25, -1.5, 30000.0, None, float("nan"), float("inf"), 1e300,
            float(FIRST_DAY), float(FIRST_DAY) - 1, float(END_DAY) - 0.5, float(END_DAY)]
    assert through(spark, days, "double", sas_date) == [
        dt.date(2016, 4, 29), dt.date(2016, 4, 29), dt.date(1960, 1, 1), dt.date(1959, 12, 31),
        dt.date(1959, 12, 30), dt.date(2042, 2, 19), None, None, None, None,
        dt.date(1, 1, 1), None, dt.date(9999, 12, 31), None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(), min_size=1, max_size=200))
def test_day_numbers_come_back(spark, dates):
    days = [float((d - dt.date(1960, 1, 1)).days) for d in dates]
    assert through(spark, days, "double", sas_date) == dates


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(), min_size=1, max_size=200))
def test_written_dates_come_back(spark, dates):
    texts = [f"{d.year:04}{d.month:02}{d.day:02}" for d in dates]
    assert through(spark, texts, "string", file_date) == dates
    texts = [f"{d.month:02}{d.day:02}{d.year:04}" for d in dates]
    assert through(spark, texts, "string", leave_date) == dates


def test_text_dates(spark, zone):
    texts = ["07162016", "D/S", None, "1232016", "junk", "02292016", "02292015", "13012016",
             "07162016 ", "07162016\n", "07160000"]
    assert through(spark, texts, "string", leave_date) == [
        dt.date(2016, 7, 16), None, None, None, None, dt.date(2016, 2, 29), None, None,
        None, None, None]
    texts = ["20160416", "20161301", None, "", "2016-04-16", "99991231", "00010101", "00000101"]
    assert through(spark, texts, "string", file_date) == [
        dt.date(2016, 4, 16), None, None, None, None, dt.date(9999, 12, 31), dt.date(1, 1, 1),
        None]


def test_identifiers(spark):
    assert through(spark, ["55780468433.0", "1.05.0", "1.0.0", "7", None, ".0"], "string",
                   whole_id) == ["55780468433", "1.05", "1.0", "7", None, ""]


def test_integers(spark):
    assert through(spark, [3.0, 3.9, -3.9, 1e12, float("nan"), None], "double", to_int) == [
        3, 3, -3, None, None, None]
    assert through(spark, ["3", "3.0", "x", None, "1e20"], "string",
                   lambda c: text_to(c, "int"), lambda c: text_to(c, "double")) == [
        (3, 3.0), (3, 3.0), (None, None), (None, None), (None, 1e20)]
