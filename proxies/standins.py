"""Border-entry data derived from the given tables.

The given tables hold no entries, label texts or demographics, so Spark derives
them: an entry per order, a port per part, a country per customer, a city row
per customer, a state per nation. Every derived set grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from portolan.functions.dates import DAY_ZERO
from portolan.schemas import RAW_ENTRIES

# State codes by number: one per nation, then three that no dimension knows.
CODES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
         "KS", "KY", "LA", "ME", "MD", "TX", "WA", "NY", "OH", "PR", "XX", "YY", "ZZ"]
KNOWN = 25

ENTRIES_PER_BLOCK = 1000  # label entries in one rendered block


# The given tables, so that opening one runs no schema job.
GIVEN = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def code(number: str) -> str:
    """SQL for the state code of a number."""
    return f"elt(int({number}) + 1, {str(CODES)[1:-1]})"


# Raw column -> SQL over `orders`, with the blemishes real entries have.
RAW_FROM_ORDERS = {
    "_c0": "string(o_orderkey)",
    "cicid": "double(o_orderkey)",
    "i94yr": "double(year(day))",
    "i94mon": "double(month(day))",
    "i94cit": "double(o_custkey % 25)",
    "i94res": "double(o_custkey % 30)",
    "i94port": "concat('P', o_custkey)",
    "arrdate": f"datediff(day, date'{DAY_ZERO}') + double(o_orderkey % 4) / 4",
    "i94mode": "case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then 1d "
               "when o_orderstatus = 'O' then 2d else 3d end",
    "i94addr": code("o_custkey % 28"),
    "depdate": f"if(o_orderkey % 7 = 0, null, "
               f"double(datediff(day, date'{DAY_ZERO}') + o_orderkey % 30))",
    "i94bir": "double(18 + o_orderkey % 60)",
    "i94visa": "double(left(o_orderpriority, 1))",
    "count": "1d",
    "dtadfile": "if(o_orderkey % 13 = 0, '20161301', replace(string(day), '-', ''))",
    "visapost": "'SYD'",
    "occup": "if(o_orderkey % 50 = 0, 'STU', null)",
    "entdepa": "'G'",
    "entdepd": "'O'",
    "entdepu": "string(null)",
    "matflag": "'M'",
    "biryear": "double(year(day) - 18 - o_orderkey % 60)",
    "dtaddto": "case when o_orderkey % 10 = 0 then 'D/S' when o_orderkey % 17 = 0 then '1232016' "
               "else concat(substring(string(date_add(day, 90)), 6, 2), "
               "substring(string(date_add(day, 90)), 9, 2), "
               "substring(string(date_add(day, 90)), 1, 4)) end",
    "gender": "if(o_orderkey % 2 = 0, 'F', 'M')",
    "insnum": "if(o_orderkey % 9 = 0, string(o_orderkey), null)",
    "airline": "o_orderpriority",
    "admnum": "concat(o_orderkey, if(o_orderkey % 3 = 0, '.05.0', '.0'))",
    "fltno": "lpad(string(o_custkey % 1000), 5, '0')",
    "visatype": "concat('B', left(o_orderpriority, 1))",
}


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw entry per order."""
    orders = table(spark, sf_dir, "orders").selectExpr("*", "date(o_orderdate) as day")
    return orders.selectExpr(
        *[f"{RAW_FROM_ORDERS[name]} as {name}" for name in RAW_ENTRIES.fieldNames()])


# Printed label of a port by the last digits of its number; `port`, `name` and
# `state` are what the label is about. Other numbers print "name, state".
PORT_SHAPES = [
    "concat('No PORT Code (', port, ')')",
    "concat('Collapsed (', port, ') 06/15')",
    "'UNIDENTIFED AIR / SEAPORT'",
    "'UNKNOWN POE'",
    "'BELLINGHAM, WASHINGTON #INTL'",
    "'PASO DEL NORTE,TX'",
    "concat('INT', chr(39), chr(39), 'L ', name, ', ', state)",
    "concat('LA ', name, ', NY')",
    "concat(name, '/', state)",
    "concat(name, ', CANADA')",
    "concat('PUT-IN-BAY ', name, ', OH')",
    "concat(name, ', ', state, ' (BPS)')",
]


def port_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, code, value): a port label per part, in every printed shape."""
    shapes = " ".join(f"when {i} then {shape}" for i, shape in enumerate(PORT_SHAPES))
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey as number", "concat('P', p_partkey) as port",
                    "upper(p_name) as name", f"{code('p_partkey % 28')} as state")
        .selectExpr("number", "port as code",
                    f"case number % 20 {shapes} else concat(name, ', ', state) end as value")
    )


# List keyword line, table, key and printed entry of each label list.
LABEL_LISTS = [
    ("\r\n/* I94CIT & I94RES - valid and invalid codes */\r\n  value cntyl\r\n",
     "customer", "c_custkey", r"format_string('   %d =  \'%s \'', c_custkey, c_name)"),
    ("\r\n/* I94MODE - missing and not reported */\r\nvalue model\r\n",
     "region", "r_regionkey", r"format_string('\t%d = \'%s\'', r_regionkey + 1, r_name)"),
    ("\r\n/* I94ADDR - everything else goes into 'other' */\r\nvalue addrl\r\n",
     "nation", "n_nationkey", rf"format_string('\t\'%s\'=\'%s\'', {code('n_nationkey')}, n_name)"),
    ("\r\n/* I94VISA - Visa codes collapsed:\r\n",
     "region", "r_regionkey", "format_string('   %d = %s', r_regionkey + 1, r_name)"),
]
PORT_LIST = ("\r\n\r\n/* I94PORT - valid and invalid codes */\r\n  value $prtl\r\n",
             r"format_string('   \'%s\'\t=\t\'%s     \'', code, value)")


def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, block): code lists rendered as label text.

    A rendered block holds the entries of 1000 consecutive, distinct keys, so
    its size does not depend on the data.
    """
    blocks = _rendered(port_labels(spark, sf_dir), PORT_LIST[0], "number", PORT_LIST[1])
    for head, name, key, entry in LABEL_LISTS:
        blocks = blocks.unionByName(_rendered(table(spark, sf_dir, name), head, key, entry))
    return blocks


def _rendered(entries: DataFrame, head: str, key: str, entry: str) -> DataFrame:
    return entries.groupBy(
        F.expr(f"concat('labels-', {key} div {ENTRIES_PER_BLOCK}) as source")
    ).agg(F.concat(F.lit(head), F.concat_ws("\r\n", F.collect_list(F.expr(entry))),
                   F.lit("\r\n")).alias("block"))


# Entries that are not of their list's shape: a quoted country code, a state code in
# small letters.
BROKEN_ENTRIES = {
    "customer": r"if(c_custkey % 97 = 0, format_string('   \'%d\' =  \'%s \'', c_custkey, c_name), {})",
    "nation": r"if(n_nationkey % 5 = 0, format_string('\t\'%s\'=\'%s\'', lower({code}), n_name), {})",
}


def broken_label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`label_blocks` of the country and state lists, with entries of a wrong shape."""
    blocks = None
    for head, name, key, entry in LABEL_LISTS:
        if name in BROKEN_ENTRIES:
            broken = BROKEN_ENTRIES[name].replace("{code}", code(key)).replace("{}", entry)
            rendered = _rendered(table(spark, sf_dir, name), head, key, broken)
            blocks = rendered if blocks is None else blocks.unionByName(rendered)
    return blocks


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, number, line): a label text that holds every list once, with all of
    `part`, `customer`, `nation` and `region`; its lines are in order by both numbers."""
    lists = [(PORT_LIST[0], port_labels(spark, sf_dir), "number", PORT_LIST[1])]
    lists += [(head, table(spark, sf_dir, name), key, entry) for head, name, key, entry in LABEL_LISTS]
    lines = None
    for section, (head, rows, key, entry) in enumerate(lists):
        around = [(section, place - 1000, line) for place, line in enumerate(head.strip().split("\r\n"))]
        fixed = spark.createDataFrame([*around, (section, (1 << 62), ";")],
                                      "section int, number bigint, line string")
        entries = rows.selectExpr(f"{section} as section", f"cast({key} as bigint) as number",
                                  f"{entry} as line")
        lines = fixed.unionByName(entries) if lines is None else lines.unionByName(
            fixed).unionByName(entries)
    return lines


# Header of the demographics text -> SQL over `customer`; `city` is its number.
CITIES_FROM_CUSTOMER = {
    "City": "concat('City ', city)",
    "State": f"concat('State ', city % {KNOWN})",
    "Median Age": "string(20.5d + city % 40)",
    "Male Population": "string(1000 + city % 9000)",
    "Female Population": "if(city % 37 = 0, 'n/a', string(1200 + city % 7000))",
    "Total Population": "concat(2200 + city % 9000 + city % 7000, '.0')",
    "Number of Veterans": "string(city % 500)",
    "Foreign-born": "string(city % 800)",
    "Average Household Size": "string(2 + double(city % 4) / 4)",
    "State Code": code(f"city % {KNOWN}"),
    "Race": "concat('Race ', c_custkey % 3)",
    "Count": "string(c_custkey)",
}


def demographics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city per three customers with a row per race, every column as text."""
    customer = table(spark, sf_dir, "customer").selectExpr("*", "c_custkey div 3 as city")
    return customer.selectExpr(
        *[f"{text} as `{name}`" for name, text in CITIES_FROM_CUSTOMER.items()])


# What goes wrong in a line of demographics text, by the customer's number: the text
# after its last field (a line end begins a line of its own), and its veterans.
BROKEN_LINE = """
    case when c_custkey % 41 = 0 then concat(chr(10), 'City short;State short')
         when c_custkey % 43 = 0 then ';more;fields' else '' end"""
BROKEN_NUMBER = """
    case when c_custkey % 47 = 0 then '1.9' when c_custkey % 53 = 0 then '3000000000'
         else string(city % 500) end"""


def broken_demographics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`demographics_text` with short lines, long lines, fractions and overflow; to be
    written without quotes."""
    customer = table(spark, sf_dir, "customer").selectExpr("*", "c_custkey div 3 as city")
    texts = {**CITIES_FROM_CUSTOMER, "Number of Veterans": BROKEN_NUMBER,
             "Count": f"concat(string(c_custkey), {BROKEN_LINE})"}
    return customer.selectExpr(*[f"{text} as `{name}`" for name, text in texts.items()])


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The dimensions the derived entries point to; `dim_port` grows with `part`."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return {
        "dim_country": nation.selectExpr("n_nationkey as region_key", "n_name as region_name"),
        "dim_state": nation.selectExpr(f"{code('n_nationkey')} as state_code", "n_name as state"),
        "dim_i94_mode": region.selectExpr("r_regionkey + 1 as i94mode_key", "r_name as i94mode"),
        "dim_visa": region.selectExpr("r_regionkey + 1 as visa_key",
                                      "r_name as visa_broad_type"),
        "dim_port": table(spark, sf_dir, "part").selectExpr(
            "concat('P', p_partkey) as port_key", f"{code(f'p_partkey % {KNOWN}')} as state",
            "upper(p_name) as address"),
    }
