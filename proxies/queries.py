"""One query per operator family, over the whole of the given tables.

Dates leave as ISO text, so that every engine renders them alike; the tables
behind the queries hold real dates (see the contract tests).
"""

from __future__ import annotations

import datetime
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType

from portolan.operators import analytics, demographics, labels, ports, star
from portolan.operators.calendar import build_calendar
from portolan.operators.demographics import build_demographics, project_demographics
from portolan.operators.fact import build_fact, reject_counts, reject_rows
from portolan.operators.keys import dense_index
from portolan.operators.quality import quality_report
from portolan.functions.dates import file_date, leave_date, sas_date
from portolan.functions.text import header_name
from portolan.plans import jobs
from portolan.schemas import CSV, LABEL_STAGING, PARTITIONS
from portolan.scratch import new_folder
from portolan.sinks.clustered import clustered_join, save_clustered
from portolan.sinks.tables import write_flat, write_partitioned
from portolan.sources.demographics import read_demographics
from portolan.sources.entries import read_entries
from portolan.sources.labels import read_label_blocks, read_label_staging
from portolan.sources.tables import read_table
from proxies import standins

LATE = datetime.date(2016, 12, 31)
EARLY = datetime.date(1999, 12, 31)
RELOADED = (1998, 5)


def iso(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, DateType)
        else F.col(f.name) for f in df.schema])


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_fact(standins.raw_entries(spark, sf_dir))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_calendar(fact(spark, sf_dir))


# Fact and calendar

def fact_entries(spark, sf_dir):
    return iso(fact(spark, sf_dir))


def entries_parquet(spark, sf_dir):
    path = new_folder(spark, "entries")
    standins.raw_entries(spark, sf_dir).write.parquet(path)
    return iso(build_fact(read_entries(spark, path)))


def entries_csv(spark, sf_dir):
    path = new_folder(spark, "entries")
    write_flat(standins.raw_entries(spark, sf_dir), path, "csv")
    return iso(build_fact(read_entries(spark, path, "csv")))


def sas_dates(spark, sf_dir):
    return iso(standins.raw_entries(spark, sf_dir).select(
        F.col("cicid").try_cast("bigint").alias("entry"),
        sas_date(F.col("arrdate")).alias("arrival"),
        sas_date(F.col("depdate")).alias("departure")))


def text_dates(spark, sf_dir):
    return iso(standins.raw_entries(spark, sf_dir).select(
        F.col("cicid").try_cast("bigint").alias("entry"),
        file_date(F.col("dtadfile")).alias("filed"),
        leave_date(F.col("dtaddto")).alias("leave_by")))


def calendar_dim(spark, sf_dir):
    return iso(calendar(spark, sf_dir))


def rejects(spark, sf_dir):
    return reject_counts(standins.raw_entries(spark, sf_dir))


# Sinks and read-back

def fact_write(spark, sf_dir):
    path = new_folder(spark, "fact")
    write_partitioned(fact(spark, sf_dir), path, PARTITIONS["fact_i94"])
    return iso(read_table(spark, "fact_i94", path))


def fact_month_reload(spark, sf_dir):
    """A corrected month replaces itself; the others stay."""
    path = new_folder(spark, "fact")
    entries = fact(spark, sf_dir)
    write_partitioned(entries, path, PARTITIONS["fact_i94"])
    year, month = RELOADED
    corrected = entries.where((F.col("i94yr") == year) & (F.col("i94mon") == month)).withColumn(
        "i94_count", F.lit(2))
    write_partitioned(corrected, path, PARTITIONS["fact_i94"], reload=True, gather=False)
    return star.people_by(read_table(spark, "fact_i94", path), ["i94yr", "i94mon"])


def calendar_write(spark, sf_dir):
    path = new_folder(spark, "calendar")
    write_partitioned(calendar(spark, sf_dir), path, PARTITIONS["dim_time"])
    return iso(read_table(spark, "dim_time", path))


def csv_roundtrip(spark, sf_dir):
    path = new_folder(spark, "customer")
    customer = standins.table(spark, sf_dir, "customer")
    write_flat(customer, path, "csv")
    return spark.read.schema(customer.schema).options(**CSV).csv(path)


# Labels

def _label_files(spark, sf_dir):
    path = new_folder(spark, "labels")
    standins.label_blocks(spark, sf_dir).select("block").write.option("lineSep", ";").text(path)
    return read_label_blocks(spark, path)


def _staging(spark, sf_dir):
    return labels.parse_labels(labels.select_blocks(standins.label_blocks(spark, sf_dir)))


def _staging_table(spark, sf_dir):
    """Staging as the label job leaves it: a folder per list, read list by list."""
    path = new_folder(spark, "staging")
    write_partitioned(_staging(spark, sf_dir).select(*LABEL_STAGING.fieldNames()), path, ["type"])
    return read_label_staging(spark, path)


def label_blocks(spark, sf_dir):
    found = labels.select_blocks(_label_files(spark, sf_dir))
    return found.groupBy("type").agg(F.count("*").alias("blocks"))


def label_block_faults(spark, sf_dir):
    return labels.block_faults(standins.label_blocks(spark, sf_dir))


def label_parse(spark, sf_dir):
    return labels.parse_labels(labels.select_blocks(_label_files(spark, sf_dir))).drop("source")


def label_union(spark, sf_dir):
    return _staging(spark, sf_dir).groupBy("source", "type").agg(
        F.count("*").alias("entries"), F.min("value").alias("first_value"),
        F.max("value").alias("last_value"))


def label_dim_split(spark, sf_dir):
    path = new_folder(spark, "staging")
    write_flat(_staging(spark, sf_dir).select(*LABEL_STAGING.fieldNames()), path, "csv")
    return _keys_and_labels(labels.build_dims(read_label_staging(spark, path, "csv")), TWO_COLUMNS)


TWO_COLUMNS = ("dim_country", "dim_i94_mode", "dim_state", "dim_visa")


def _keys_and_labels(dims, names):
    """(table_name, key, label) of the dimensions named; other columns joined by a blank."""
    return reduce(DataFrame.unionByName, [
        dims[name].select(F.lit(name).alias("table_name"),
                          F.col(dims[name].columns[0]).cast("string").alias("key"),
                          F.concat_ws(" ", *dims[name].columns[1:]).alias("label"))
        for name in names])


def label_rejects(spark, sf_dir):
    """Entries that are not of their list's shape are counted, list by list."""
    broken = labels.select_blocks(standins.broken_label_blocks(spark, sf_dir))
    return labels.label_rejects(broken).drop("example")


def sentinel_override(spark, sf_dir):
    return standins.port_labels(spark, sf_dir).select(
        "code", ports.settle_label(F.col("value")).alias("label"))


def _port_staging(spark, sf_dir):
    staging = _staging(spark, sf_dir)
    return labels.of_type(staging, "port"), labels.of_type(staging, "state")


def port_us_filter(spark, sf_dir):
    port_rows, states = _port_staging(spark, sf_dir)
    return ports.us_ports(port_rows, states).select("code", "state")


def port_dim(spark, sf_dir):
    return labels.build_port_dim(_staging_table(spark, sf_dir))


# Keys and demographics

def surrogate_key(spark, sf_dir):
    customer = standins.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dense_index(customer, ["c_custkey"], "customer_no")


def surrogate_key_hot(spark, sf_dir):
    """Ordered by a column with three values: each holds a third of the rows."""
    orders = standins.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    numbered = dense_index(orders, ["o_orderstatus"], "order_no")
    return numbered.groupBy("o_orderstatus").agg(
        F.min("order_no").alias("first_no"), F.max("order_no").alias("last_no"),
        F.count("*").alias("n"), F.sum("order_no").alias("sum_no"))


def _demographics_file(spark, sf_dir):
    path = new_folder(spark, "cities")
    (standins.demographics_text(spark, sf_dir)
     .write.option("header", True).option("sep", ";").csv(path))
    return read_demographics(spark, path)


def _demographics_rows(spark, sf_dir):
    """The same rows as from a file, without one."""
    texts = standins.demographics_text(spark, sf_dir)
    return texts.toDF(*[header_name(name) for name in texts.columns])


def demographics_rejects(spark, sf_dir):
    """Short and long lines, fractions and overflow are all counted."""
    path = new_folder(spark, "cities")
    (standins.broken_demographics_text(spark, sf_dir).write
     .option("header", True).option("sep", ";").option("quote", "\u0000").csv(path))
    return demographics.demographics_rejects(read_demographics(spark, path))


def demographics_project(spark, sf_dir):
    return project_demographics(_demographics_file(spark, sf_dir))


def demographics_fact(spark, sf_dir):
    return build_demographics(_demographics_file(spark, sf_dir))


# Quality

def quality_fact(spark, sf_dir):
    """Judged as of 1999: later entries must fail the check."""
    return quality_report({"fact_i94": fact(spark, sf_dir)}, EARLY)


def quality_calendar(spark, sf_dir):
    return quality_report({"dim_time": calendar(spark, sf_dir)}, LATE)


def quality_dims(spark, sf_dir):
    return quality_report(labels.build_dims(_staging_table(spark, sf_dir)), LATE)


def quality_all(spark, sf_dir):
    return quality_report({
        "fact_i94": fact(spark, sf_dir),
        "dim_time": calendar(spark, sf_dir),
        "fact_demographics": project_demographics(_demographics_rows(spark, sf_dir)),
        **standins.dimensions(spark, sf_dir),
    }, LATE)


def quality_failures(spark, sf_dir):
    """Tables in which something is wrong: every verdict there is."""
    dims, days = standins.dimensions(spark, sf_dir), calendar(spark, sf_dir)
    no_day = days.limit(1).withColumn("arrival_date", F.lit(None).cast("date"))
    country, state = dims["dim_country"], dims["dim_state"]
    return quality_report({
        "fact_i94": fact(spark, sf_dir),
        "dim_time": days.unionByName(no_day),
        "dim_country": country.withColumn("region_key", F.nullif("region_key", F.lit(0))),
        "dim_state": state.unionByName(state),
        "dim_visa": dims["dim_visa"].where("visa_key < 0"),
        "dim_port": dims["dim_port"],
    }, EARLY)


# Whole jobs

def _lake(spark, **paths):
    """A job's settings in a folder of its own; paths are filled in by name."""
    return jobs.JobConfig(lake="{root}/lake", as_of=LATE,
                          params={"root": new_folder(spark, "job")}, **paths)


def _entries_job(spark, sf_dir, parts):
    """Settings of the fact job after the entries of each part were loaded in turn."""
    cfg = _lake(spark, entries="{root}/entries-{part}")
    raw = standins.raw_entries(spark, sf_dir)
    for part, rows in parts.items():
        own = replace(cfg, params={**cfg.params, "part": part})
        raw.where(rows).write.parquet(own.path("entries"))
        jobs.load_fact(spark, own)
    return cfg


def job_fact(spark, sf_dir):
    cfg = _entries_job(spark, sf_dir, {"all": "true"})
    return iso(jobs.open_table(spark, cfg, "fact_i94"))


def job_fact_months(spark, sf_dir):
    """Two loads, each with its own months: the second keeps those of the first."""
    cfg = _entries_job(spark, sf_dir, {"early": "i94yr < 1998", "late": "i94yr >= 1998"})
    return star.people_by(jobs.open_table(spark, cfg, "fact_i94"), ["i94yr", "i94mon"])


def job_calendar(spark, sf_dir):
    cfg = _entries_job(spark, sf_dir, {"all": "true"})
    return iso(jobs.load_calendar(spark, cfg))


def _label_text(spark, sf_dir, cfg):
    """One text in many files, the lists cut anywhere."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (standins.label_lines(spark, sf_dir).repartitionByRange(files, "section", "number")
     .sortWithinPartitions("section", "number").select("line")
     .write.option("lineSep", "\r\n").text(cfg.path("labels")))


def _corrected_lake(spark, sf_dir):
    """All entries loaded, and then a corrected month: its people count twice and its
    entries with an odd number are gone."""
    cfg = _entries_job(spark, sf_dir, {"all": "true"})
    year, month = RELOADED
    own = replace(cfg, params={**cfg.params, "part": "corrected"})
    standins.raw_entries(spark, sf_dir).where(
        f"i94yr = {year} and i94mon = {month} and cicid % 2 = 0").withColumn("count", F.lit(2.0)).write.parquet(
        own.path("entries"))
    jobs.load_fact(spark, own)
    return own


def job_calendar_reload(spark, sf_dir):
    """The calendar after a month lost most of its days: only its year is written again."""
    cfg = _entries_job(spark, sf_dir, {"all": "true"})
    jobs.load_calendar(spark, cfg)
    year, month = RELOADED
    own = replace(cfg, params={**cfg.params, "part": "corrected"})
    standins.raw_entries(spark, sf_dir).where(
        f"i94yr = {year} and i94mon = {month} and arrdate % 1 = 0 and cast(arrdate as int) % 5 = 0").write.parquet(
        own.path("entries"))
    jobs.load_fact(spark, own)
    return iso(jobs.load_calendar(spark, own))


def rollup_by_month_counts(spark, sf_dir):
    """Subtotals from the counts kept by month, after a month was loaded again."""
    cfg = _corrected_lake(spark, sf_dir)
    return analytics.star_rollup(jobs.open_table(spark, cfg, "fact_counts"))


def growth_by_month_counts(spark, sf_dir):
    cfg = _corrected_lake(spark, sf_dir)
    return analytics.month_on_month(jobs.open_table(spark, cfg, "fact_counts"))


def entry_reject_rows(spark, sf_dir):
    """Every value that typing lost, as the fact load leaves it beside the fact."""
    cfg = _entries_job(spark, sf_dir, {"all": "true"})
    return reject_rows(jobs.open_table(spark, cfg, "entry_rejects"))


def load_ledger(spark, sf_dir):
    """Two loads of the same files and one of others: months by the load they are from."""
    cfg = _entries_job(spark, sf_dir, {"early": "i94yr < 1998", "late": "i94yr >= 1998"})
    again = replace(cfg, params={**cfg.params, "part": "early"})
    jobs.load_fact(spark, again)
    ledger = jobs.open_table(spark, cfg, "load_ledger")
    return ledger.select("i94yr", "i94mon", F.regexp_extract("source", "entries-(.*)$", 1).alias("part"),
                         "months", F.expr("aggregate(losses, 0L, (t, l) -> t + l.rejected)").alias("lost"))


def job_labels(spark, sf_dir):
    cfg = _lake(spark, labels="{root}/labels", labels_one_text=True)
    _label_text(spark, sf_dir, cfg)
    return _keys_and_labels(jobs.load_labels(spark, cfg), (*TWO_COLUMNS, "dim_port"))


def _cities_text(spark, sf_dir, cfg):
    (standins.demographics_text(spark, sf_dir)
     .write.option("header", True).option("sep", ";").csv(cfg.path("demographics")))


def job_demographics(spark, sf_dir):
    cfg = _lake(spark, demographics="{root}/cities")
    _cities_text(spark, sf_dir, cfg)
    return jobs.load_demographics(spark, cfg)


def job_check(spark, sf_dir):
    """All jobs, then the report over what they published."""
    cfg = _lake(spark, entries="{root}/entries", labels="{root}/labels",
                labels_one_text=True, demographics="{root}/cities", dims_fmt="csv")
    standins.raw_entries(spark, sf_dir).write.parquet(cfg.path("entries"))
    _label_text(spark, sf_dir, cfg)
    _cities_text(spark, sf_dir, cfg)
    return jobs.run_all(spark, cfg)


# Star queries

def star_count(spark, sf_dir):
    return analytics.entries_by_state_month_visa(
        fact(spark, sf_dir), standins.dimensions(spark, sf_dir))


def port_count(spark, sf_dir):
    """The port dimension grows with the data: the join must not assume it small."""
    return star.star_count(fact(spark, sf_dir), standins.dimensions(spark, sf_dir),
                           ["port"], ["i94yr"])


def star_join(spark, sf_dir):
    dims = {**standins.dimensions(spark, sf_dir), "dim_time": calendar(spark, sf_dir)}
    entries = fact(spark, sf_dir).select(
        "i94_key", "cit_region_key", "res_region_key", "port_key", "i94mode_key",
        "state_code", "visa_key", "arrival_date")
    return iso(star.star_join(entries, dims, list(star.LINKS)))


def star_join_clustered(spark, sf_dir):
    """Ports joined to entries that lie in buckets by port."""
    root = new_folder(spark, "clustered")
    entries = fact(spark, sf_dir).select("i94_key", "port_key", "state_code", "visa_key")
    write_flat(entries, f"{root}/fact")
    save_clustered(spark.read.parquet(f"{root}/fact"), f"{root}/by_port", "port", 16)
    return clustered_join(spark, f"{root}/by_port", standins.dimensions(spark, sf_dir))


def star_rollup(spark, sf_dir):
    return analytics.star_rollup(fact(spark, sf_dir))


def per_capita(spark, sf_dir):
    return analytics.entries_per_resident(
        fact(spark, sf_dir), project_demographics(_demographics_rows(spark, sf_dir))
    ).withColumn("per_thousand", F.round("per_thousand", 6))


def unknown_member(spark, sf_dir):
    return star.with_unknown_member(
        fact(spark, sf_dir), standins.dimensions(spark, sf_dir)["dim_state"]
    ).select("i94_key", "state_code")


def orphan_keys(spark, sf_dir):
    return star.orphan_report(
        fact(spark, sf_dir), standins.dimensions(spark, sf_dir),
        ["citizenship", "residence", "mode", "state", "visa", "port"])


def topk_destinations(spark, sf_dir):
    return analytics.top_destinations(
        fact(spark, sf_dir), standins.dimensions(spark, sf_dir), 10)


def topk_ports_per_visa(spark, sf_dir):
    return analytics.top_ports_per_visa(
        fact(spark, sf_dir), standins.dimensions(spark, sf_dir), 5)


def mom_growth(spark, sf_dir):
    return analytics.month_on_month(fact(spark, sf_dir))


QUERIES = {
    "fact_entries": fact_entries,
    "entries_parquet": entries_parquet,
    "entries_csv": entries_csv,
    "sas_date": sas_dates,
    "text_dates": text_dates,
    "calendar_dim": calendar_dim,
    "reject_counts": rejects,
    "fact_write": fact_write,
    "fact_month_reload": fact_month_reload,
    "calendar_write": calendar_write,
    "csv_roundtrip": csv_roundtrip,
    "label_blocks": label_blocks,
    "label_block_faults": label_block_faults,
    "label_parse": label_parse,
    "label_union": label_union,
    "label_dim_split": label_dim_split,
    "label_rejects": label_rejects,
    "sentinel_override": sentinel_override,
    "port_us_filter": port_us_filter,
    "port_dim": port_dim,
    "surrogate_key": surrogate_key,
    "surrogate_key_hot": surrogate_key_hot,
    "demographics_project": demographics_project,
    "demographics_fact": demographics_fact,
    "demographics_rejects": demographics_rejects,
    "quality_fact": quality_fact,
    "quality_calendar": quality_calendar,
    "quality_dims": quality_dims,
    "quality_report": quality_all,
    "quality_failures": quality_failures,
    "job_fact": job_fact,
    "job_fact_months": job_fact_months,
    "job_calendar": job_calendar,
    "job_calendar_reload": job_calendar_reload,
    "rollup_by_month_counts": rollup_by_month_counts,
    "growth_by_month_counts": growth_by_month_counts,
    "entry_reject_rows": entry_reject_rows,
    "load_ledger": load_ledger,
    "job_labels": job_labels,
    "job_demographics": job_demographics,
    "job_check": job_check,
    "star_count": star_count,
    "port_count": port_count,
    "star_join": star_join,
    "star_join_clustered": star_join_clustered,
    "star_rollup": star_rollup,
    "per_capita": per_capita,
    "unknown_member": unknown_member,
    "orphan_keys": orphan_keys,
    "topk_destinations": topk_destinations,
    "topk_ports_per_visa": topk_ports_per_visa,
    "mom_growth": mom_growth,
}
