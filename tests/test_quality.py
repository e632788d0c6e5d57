import datetime as dt

import pytest

from portolan.operators.quality import QualityError, gate, quality_report
from portolan.schemas import TABLES
from tests.helpers import plan

AS_OF = dt.date(2016, 6, 1)


def table(spark, name, *rows):
    names = TABLES[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[name])


def verdicts(report):
    return {(r.table_name, r.check_name): (r.passed, r.value, r.detail) for r in report.collect()}


def test_pass(spark):
    report = quality_report({
        "fact_i94": table(spark, "fact_i94", {"i94yr": 2015}, {"i94yr": 2016}),
        "dim_time": table(spark, "dim_time", {"arrival_date": AS_OF}),
        "dim_port": table(spark, "dim_port", {"port_key": "A"})}, AS_OF)
    assert verdicts(report) == {
        ("fact_i94", "not_empty"): (True, 2, "passed"),
        ("fact_i94", "entry_year_not_future"): (True, 2016, "passed"),
        ("dim_time", "not_empty"): (True, 1, "passed"),
        ("dim_time", "arrival_date_not_null"): (True, 0, "passed"),
        ("dim_port", "not_empty"): (True, 1, "passed"),
        ("dim_port", "port_key_not_null"): (True, 0, "passed"),
        ("dim_port", "port_key_unique"): (True, 0, "passed")}
    gate(report)


def test_every_failure_is_named(spark):
    report = quality_report({
        "fact_i94": table(spark, "fact_i94", {"i94yr": 2017}),
        "dim_time": table(spark, "dim_time", {}, {"arrival_date": AS_OF}),
        "dim_visa": table(spark, "dim_visa"),
        "dim_country": table(spark, "dim_country", {"region_key": 1}, {}),
        "dim_state": table(spark, "dim_state", {"state_code": "NY"}, {"state_code": "NY"},
                           {"state_code": "TX"})}, AS_OF)
    with pytest.raises(QualityError) as error:
        gate(report)
    assert "year to come (value 2017)" in str(error.value)
    assert "arrival_date is missing in some rows (value 1)" in str(error.value)
    assert "dim_visa.not_empty" in str(error.value)
    assert "state_code occurs more than once (value 1)" in str(error.value)
    assert "region_key is missing in some rows (value 1)" in str(error.value)


def test_empty_table_leaves_the_rest_open(spark):
    found = verdicts(quality_report({"fact_i94": table(spark, "fact_i94")}, AS_OF))
    assert found["fact_i94", "not_empty"] == (False, 0, "the table is empty")
    passed, _, detail = found["fact_i94", "entry_year_not_future"]
    assert passed is None and detail.startswith("not evaluated")


def test_year_all_missing_fails(spark):
    found = verdicts(quality_report({"fact_i94": table(spark, "fact_i94", {})}, AS_OF))
    assert found["fact_i94", "entry_year_not_future"][0] is False


def test_one_pass_per_table(spark, tmp_path):
    path = str(tmp_path / "fact")
    table(spark, "fact_i94", {"i94yr": 2016}).write.parquet(path)
    report = quality_report({"fact_i94": spark.read.parquet(path)}, AS_OF)
    physical = plan(report).split("== Physical Plan ==")[1]
    assert physical.count("FileScan") == 1 and "ReadSchema: struct<i94yr:int>" in physical
