import datetime as dt

from pyspark.sql import functions as F

from portolan.operators.calendar import build_calendar
from portolan.operators.fact import build_fact, reject_counts
from portolan.operators.quality import quality_report
from portolan.schemas import FACT_COLUMNS, RAW_ENTRIES, TABLES
from portolan.sources.entries import read_entries
from tests.helpers import entries, plan

FULL = {
    "_c0": "0", "cicid": 7.0, "i94yr": 2016.0, "i94mon": 4.0, "i94cit": 236.0, "i94res": 101.0,
    "i94port": "FMY", "arrdate": 20573.0, "i94mode": 1.0, "i94addr": "FL", "depdate": 20575.0,
    "i94bir": 30.0, "i94visa": 2.0, "count": 1.0, "dtadfile": "20160429", "visapost": "SYD",
    "occup": "STU", "entdepa": "G", "entdepd": "O", "entdepu": "U", "matflag": "M",
    "biryear": 1986.0, "dtaddto": "10282016", "gender": "F", "insnum": "3517", "airline": "CI",
    "admnum": "55780468433.0", "fltno": "00012", "visatype": "B2",
}


def test_contract(spark):
    assert len(RAW_ENTRIES) == 29 and len(FACT_COLUMNS) == 23
    fact = build_fact(entries(spark, FULL))
    assert [(f.name, f.dataType) for f in fact.schema] == [
        (f.name, f.dataType) for f in TABLES["fact_i94"]]
    assert fact.first().asDict() == {
        "i94_key": 7, "res_region_key": 101, "cit_region_key": 236, "port_key": "FMY",
        "arrival_date": dt.date(2016, 4, 29), "i94yr": 2016, "i94mon": 4, "i94mode_key": 1,
        "state_code": "FL", "departure_date": dt.date(2016, 5, 1), "age": 30, "visa_key": 2,
        "i94_count": 1, "i94_file_date": dt.date(2016, 4, 29), "occup": "STU", "biryear": 1986,
        "i94_leave_date": dt.date(2016, 10, 28), "gender": "F", "insnum": "3517",
        "airline": "CI", "i94_admin_num": "55780468433", "fltno": "00012", "visatype": "B2"}


def test_missing_values_stay_missing(spark):
    assert set(build_fact(entries(spark, {})).first()) == {None}


def test_rejects(spark):
    raw = entries(
        spark, FULL, {}, {"cicid": 1e12, "dtadfile": "20161301", "dtaddto": "D/S"},
        {"arrdate": 1e9, "dtaddto": "1232016"}, {"dtaddto": "junk", "i94mode": float("nan")})
    rows = {r.column_name: tuple(r)[1:] for r in reject_counts(raw).collect()}
    assert rows["i94_key"] == (2, 0, 1)
    assert rows["i94_file_date"] == (2, 0, 1)
    assert rows["i94_leave_date"] == (4, 1, 2)
    assert rows["arrival_date"] == (2, 0, 1)
    assert rows["i94mode_key"] == (2, 0, 1)
    assert rows["departure_date"] == (1, 0, 0)
    assert len(rows) == 14


def test_csv_keeps_broken_lines(spark, tmp_path):
    header = ",".join(f.name for f in RAW_ENTRIES)
    good = ["0", "1.0", "2016.0", "4.0"] + [""] * 25
    bad = ["1", "2.0", "year", "4.0"] + [""] * 25
    (tmp_path / "e.csv").write_text("\n".join([header, ",".join(good), ",".join(bad)]) + "\n")
    raw = read_entries(spark, str(tmp_path), "csv")
    assert sorted((r.i94_key, r.i94yr, r.i94mon) for r in build_fact(raw).collect()) == [
        (1, 2016, 4), (2, None, 4)]
    losses = {r.column_name: r.rejected for r in reject_counts(raw).collect()}
    assert losses["_corrupt_record"] == 1 and sum(losses.values()) == 1


def test_parquet_without_the_index_column(spark, tmp_path):
    entries(spark, FULL).drop("_c0").write.parquet(str(tmp_path / "p"))
    assert read_entries(spark, str(tmp_path / "p")).first().cicid == 7.0


def test_fact_is_narrow(spark):
    text = plan(build_fact(entries(spark, FULL)))
    assert "Exchange" not in text and "EvalPython" not in text


def test_the_checks_read_one_raw_column(spark, tmp_path):
    path = str(tmp_path / "raw")
    entries(spark, FULL).write.parquet(path)
    report = quality_report({"fact_i94": build_fact(read_entries(spark, path))})
    assert "ReadSchema: struct<i94yr:double>" in plan(report)
    assert report.where("not passed").isEmpty()


def test_calendar(spark):
    days = [20560.0, 20560.5, 20454.0, None, 20513.0]  # 2016-04-16 twice, 01-01, none, 02-29
    calendar = build_calendar(build_fact(entries(spark, *[{"arrdate": d} for d in days])))
    assert calendar.schema.simpleString() == TABLES["dim_time"].simpleString()
    assert sorted(tuple(r) for r in calendar.collect()) == [
        (dt.date(2016, 1, 1), 1, 53, 1, 2016, 6),
        (dt.date(2016, 2, 29), 29, 9, 2, 2016, 2),
        (dt.date(2016, 4, 16), 16, 15, 4, 2016, 7)]


def test_calendar_distinct_comes_before_the_parts(spark, tmp_path):
    path = str(tmp_path / "fact")
    build_fact(entries(spark, FULL)).write.parquet(path)
    calendar = build_calendar(spark.read.parquet(path))
    text = calendar._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<arrival_date:date>" in text
    shuffled = [line for line in text.splitlines() if "Exchange" in line]
    assert len(shuffled) == 1 and "hashpartitioning(arrival_date" in shuffled[0]


def test_sums_survive(spark, sf_dir):
    from proxies.queries import fact
    from portolan.operators.analytics import star_rollup
    rows = star_rollup(fact(spark, sf_dir)).where("level in (0, 7)").groupBy("level").agg(
        F.sum("people").alias("people"), F.count("*").alias("n")).collect()
    totals = {r.level: r.people for r in rows}
    assert totals[0] == totals[7] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
