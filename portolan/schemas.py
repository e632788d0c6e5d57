"""Column contracts. Every source and every published table has one."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(),
          "double": DoubleType(), "date": DateType(), "timestamp": TimestampType()}


def columns(listing: str) -> StructType:
    """`"a int, b string"` to a schema, without needing a session."""
    pairs = [item.split() for item in listing.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# The 29 raw entry columns, in file order.
RAW_ENTRIES = columns("""
    _c0 string, cicid double, i94yr double, i94mon double, i94cit double,
    i94res double, i94port string, arrdate double, i94mode double,
    i94addr string, depdate double, i94bir double, i94visa double,
    count double, dtadfile string, visapost string, occup string,
    entdepa string, entdepd string, entdepu string, matflag string,
    biryear double, dtaddto string, gender string, insnum string,
    airline string, admnum string, fltno string, visatype string
""")

CORRUPT = "_corrupt_record"

# The CSV dialect of every source and sink: a header line, a quote inside quoted
# text is doubled, blanks belong to the value, an empty text reads as NULL.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False}

# Published name, raw name, conversion (see operators.fact).
FACT_COLUMNS = [
    ("i94_key", "cicid", "int"),
    ("res_region_key", "i94res", "int"),
    ("cit_region_key", "i94cit", "int"),
    ("port_key", "i94port", "text"),
    ("arrival_date", "arrdate", "sas_date"),
    ("i94yr", "i94yr", "int"),
    ("i94mon", "i94mon", "int"),
    ("i94mode_key", "i94mode", "int"),
    ("state_code", "i94addr", "text"),
    ("departure_date", "depdate", "sas_date"),
    ("age", "i94bir", "int"),
    ("visa_key", "i94visa", "int"),
    ("i94_count", "count", "int"),
    ("i94_file_date", "dtadfile", "file_date"),
    ("occup", "occup", "text"),
    ("biryear", "biryear", "int"),
    ("i94_leave_date", "dtaddto", "leave_date"),
    ("gender", "gender", "text"),
    ("insnum", "insnum", "text"),
    ("airline", "airline", "text"),
    ("i94_admin_num", "admnum", "whole_id"),
    ("fltno", "fltno", "text"),
    ("visatype", "visatype", "text"),
]

# The demographics columns and their types.
DEMOGRAPHICS = columns("""
    city string, state string, median_age double, male_population int,
    female_population int, total_population int, number_of_veterans int,
    foreign_born int, average_household_size double, state_code string,
    race string
""")

LABEL_STAGING = columns("code string, value string, type string")

_SQL_TYPE = {"int": "int", "text": "string", "whole_id": "string",
             "sas_date": "date", "file_date": "date", "leave_date": "date"}

# Published tables: column contract of each.
TABLES = {
    "fact_i94": columns(
        ", ".join(f"{name} {_SQL_TYPE[kind]}" for name, _, kind in FACT_COLUMNS)),
    "fact_demographics": columns(
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DEMOGRAPHICS)
        + ", demo_key bigint"),
    "dim_time": columns(
        "arrival_date date, day int, week int, month int, year int, weekday int"),
    "dim_port": columns("port_key string, state string, address string"),
    "dim_country": columns("region_key int, region_name string"),
    "dim_i94_mode": columns("i94mode_key int, i94mode string"),
    "dim_state": columns("state_code string, state string"),
    "dim_visa": columns("visa_key int, visa_broad_type string"),
}

MONTH = ["i94yr", "i94mon"]
LOST_VALUES = ArrayType(columns("column_name string, raw string"))
LOSSES = columns("column_name string, present bigint, no_date_mark bigint, rejected bigint")

# What is published with the fact, month by month, and may be empty: the entries that lost
# values in typing, the counts that most questions are answered from, and what each month
# was loaded from.
SIDE_TABLES = {
    "entry_rejects": StructType([
        *columns("i94_key int, i94yr int, i94mon int").fields, StructField("rejected", LOST_VALUES)]),
    "fact_counts": columns(
        "i94yr int, i94mon int, arrival_date date, state_code string, visa_key int, "
        "people bigint, entries bigint"),
    "load_ledger": StructType([
        *columns("i94yr int, i94mon int, run string, loaded_at timestamp, source string, "
                 "files bigint, bytes bigint, fingerprint string, months bigint").fields,
        StructField("losses", ArrayType(LOSSES))]),
}

# How the large tables are laid out on disk.
PARTITIONS = {"fact_i94": MONTH, "dim_time": ["year"], **{name: MONTH for name in SIDE_TABLES}}
