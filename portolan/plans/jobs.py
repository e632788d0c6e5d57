"""The whole jobs: read, transform, write beside the lake, check, publish."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from portolan.operators.calendar import build_calendar, changed_years
from portolan.operators.demographics import (
    build_demographics, flag_losses, flagged_losses, without_flags,
)
from portolan.operators.fact import (
    Loss, build_fact_and_rejects, loss_measures, losses_of, named_measures, reject_counts,
    side_by_side,
)
from portolan.operators.labels import build_dims, listed_lines, parse_labels, require_lists
from portolan.operators.quality import (
    checks_for, gate, measures, quality_report, report_of, today,
)
from portolan.operators.star import counts_of
from portolan.schemas import LOSSES, MONTH, PARTITIONS, SIDE_TABLES, TABLES
from portolan.scratch import run_scratch
from portolan.sinks.publish import Publication, is_published, recover, remove_abandoned
from portolan.sinks.tables import save_flat, save_partitioned
from portolan.sources.demographics import read_demographics
from portolan.sources.entries import entry_files, read_entries
from portolan.sources.labels import label_files, read_label_lines, read_label_staging
from portolan.sources.tables import read_table


@dataclass(frozen=True)
class JobConfig:
    """Where a run reads and writes. Any path or glob Spark can open. With `params`,
    `{name}` in a path is filled in (and a glob's own braces must be doubled)."""

    lake: str
    entries: str = ""
    entries_fmt: str = "parquet"
    entries_by_month: bool = False      # each input file holds one month only
    labels: str = ""
    labels_one_text: bool = False       # the label files are one text, in the order of their names
    demographics: str = ""
    dims_fmt: str = "parquet"
    replace_all: bool = False           # drop the months that are not in the input
    again: bool = False                 # load entries that the ledger has as they are, too
    abandoned_hours: float = 72         # after which `tidy_lake` removes what a killed load staged
    as_of: datetime.date | None = None
    params: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        template = getattr(self, name)
        return template.format(**self.params) if self.params else template

    def table(self, name: str) -> str:
        return f"{self.path('lake').rstrip('/')}/{name}"


class Watched:
    """Aggregates taken while a write runs, so that checking reads nothing again."""

    def __init__(self, df: DataFrame, columns: list[Column]):
        self.plain, self.columns, self.seen = df, columns, Observation()
        self.df = df.observe(self.seen, *columns)

    def measured(self) -> DataFrame:
        """What was seen, as one row; waits for the write.

        Spark drops what it finds to be empty at run time, and the watch with it. Then
        the aggregates are taken from the rows themselves, of which there are none.
        """
        try:
            got = self.seen.get
        except Py4JError:
            return self.plain.agg(*self.columns)
        schema = StructType([StructField(name, LongType()) for name in got])
        return self.plain.sparkSession.createDataFrame([tuple(got.values())], schema)


def load_fact(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """Entries to `fact_i94`: months in the input replace their own, the others stay.

    With `replace_all` the input is the whole table. Entries without a year or month
    are a month of their own. The entries are read once: checks and losses are taken
    while the rows are written beside the table, and entries that lose values are written
    in the same pass to `entry_rejects`. `fact_counts` and `load_ledger` are replaced
    month by month with the fact, all or none. A load that fails, or fails its checks,
    leaves all of them as they were.

    Files that are the last ones loaded for all their months, unchanged, are not read
    again (`again` does read them).
    """
    return load_fact_and_losses(spark, cfg)[0]


def load_fact_and_losses(spark: SparkSession, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """`load_fact`, and what typing the entries lost, column by column."""
    name, as_of = "fact_i94", cfg.as_of or today()
    source = cfg.path("entries")
    files = entry_files(spark, source)
    mark = f"{files.fingerprint} {cfg.entries_fmt} {as_of.year}"
    loaded = None if cfg.again else last_load(spark, cfg, mark)
    if loaded is not None:
        return open_table(spark, cfg, name), spark.createDataFrame(loaded, LOSSES)
    raw = read_entries(spark, source, cfg.entries_fmt)
    losses, checks = loss_measures(raw), checks_for(name, as_of)
    typed = Watched(raw, named_measures(losses))
    fact = Watched(build_fact_and_rejects(typed.df), measures(checks))
    with Publication(spark) as publication:
        path = cfg.table(name)
        staged = publication.stage(path, parts_only=not cfg.replace_all)
        side = {n: publication.stage(cfg.table(n), like=path) for n in SIDE_TABLES}
        both = publication.beside(path, "entries")
        save_partitioned(side_by_side(fact.df), both, ["table", *MONTH], gather=not cfg.entries_by_month)
        gate(report_of(fact.measured(), name, checks))
        publication.take(f"{both}/table={name}", staged)
        publication.take(f"{both}/table=entry_rejects", side["entry_rejects"])
        save_partitioned(counts_of(read_table(spark, name, staged)), side["fact_counts"], MONTH)
        lost = _lost(typed, losses)
        months = read_table(spark, "fact_counts", side["fact_counts"]).select(*MONTH).distinct()
        save_partitioned(_ledger(months, lost.collect(), files, source, mark), side["load_ledger"], MONTH)
        publication.commit()
    return open_table(spark, cfg, name), lost


def _ledger(months: DataFrame, losses: list[Row], files: Row, source: str, mark: str) -> DataFrame:
    """A row per month that a load replaces: the load, what it read and what it lost."""
    lost = F.array(*[F.struct(*[F.lit(r[c]).cast(LOSSES[c].dataType).alias(c) for c in LOSSES.names])
                     for r in losses])
    return months.select(
        *MONTH, F.lit(uuid.uuid4().hex).alias("run"), F.current_timestamp().alias("loaded_at"),
        F.lit(source).alias("source"), F.lit(files.files).alias("files"), F.lit(files.bytes).alias("bytes"),
        F.lit(mark).alias("fingerprint"), F.lit(months.count()).alias("months"), lost.alias("losses"))


def last_load(spark: SparkSession, cfg: JobConfig, mark: str) -> list[Row] | None:
    """The losses of the load with this fingerprint, if all months that it wrote are still
    its own (and, with `replace_all`, the table holds no others); else None."""
    ledger = open_table(spark, cfg, "load_ledger")
    runs = ledger.groupBy("run").agg(
        F.count("*").alias("own"), F.first("months").alias("months"),
        F.first("fingerprint").alias("fingerprint"), F.first("losses").alias("losses"))
    found = runs.where((F.col("fingerprint") == mark) & (F.col("own") == F.col("months"))).first()
    if found is None or (cfg.replace_all and ledger.count() != found.months):
        return None
    return found.losses


def _lost(typed: Watched, losses: list[Loss]) -> DataFrame:
    return losses_of(typed.measured(), [loss.column for loss in losses])


def entry_rejects(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """What typing the entries would lose, column by column."""
    return reject_counts(read_entries(spark, cfg.path("entries"), cfg.entries_fmt))


def load_calendar(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """`dim_time` from the published counts, which hold every arrival date.

    Only years in which dates came or went since the calendar was last published are
    written; the others stay. Both sides of that comparison have a row per date.
    """
    name = "dim_time"
    calendar = build_calendar(open_table(spark, cfg, "fact_counts"))
    gate(quality_report({name: calendar}, cfg.as_of))
    path, years = cfg.table(name), None
    if is_published(spark, path):
        years = changed_years(open_table(spark, cfg, name), calendar)
        if not years:
            return open_table(spark, cfg, name)
        calendar = calendar.where(F.col("year").isin(years))
    with Publication(spark) as publication:
        parts = None if years is None else [f"/year={year}" for year in years]
        save_partitioned(calendar, publication.stage(path, parts=parts), PARTITIONS[name])
        publication.commit()
    return open_table(spark, cfg, name)


def load_labels(spark: SparkSession, cfg: JobConfig) -> dict[str, DataFrame]:
    """Label text to staging to the five label dimensions, published all or none. The
    text is read line by line, so a list may be of any length."""
    path = cfg.path("labels")
    lines = read_label_lines(spark, path, cfg.labels_one_text)
    selected = listed_lines(lines)
    require_lists(lines, selected, label_files(spark, path, cfg.labels_one_text))
    staging = parse_labels(selected).select("code", "value", "type")
    with Publication(spark) as publication:
        staged = publication.stage(cfg.table("label_staging"))
        if cfg.dims_fmt == "csv":
            save_flat(staging, staged, "csv")
        else:
            save_partitioned(staging, staged, ["type"])
        dims = build_dims(read_label_staging(spark, staged, cfg.dims_fmt))
        written = {}
        for name, dim in dims.items():
            folder = publication.stage(cfg.table(name))
            save_flat(dim, folder, cfg.dims_fmt)
            written[name] = read_table(spark, name, folder, cfg.dims_fmt)
        gate(quality_report(written, cfg.as_of))
        publication.commit()
    return {name: open_table(spark, cfg, name) for name in dims}


def load_demographics(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """Demographics text to `fact_demographics`."""
    return load_demographics_and_losses(spark, cfg)[0]


def load_demographics_and_losses(spark: SparkSession,
                                 cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """`load_demographics`, and what typing the texts lost, column by column.

    What a row lost goes through the numbering with it, as one number, so the text is
    read twice: to sample it for the sort, and to sort it.
    """
    name = "fact_demographics"
    raw = flag_losses(read_demographics(spark, cfg.path("demographics")))
    losses, checks = flagged_losses(raw), checks_for(name, cfg.as_of or today())
    with run_scratch(spark, name), Publication(spark) as publication:
        typed = Watched(build_demographics(raw), named_measures(losses))
        rows = Watched(without_flags(typed.df), measures(checks))
        save_flat(rows.df, publication.stage(cfg.table(name)), cfg.dims_fmt)
        gate(report_of(rows.measured(), name, checks))
        lost = spark.createDataFrame(_lost(typed, losses).collect(), LOSSES)
        publication.commit()
    return open_table(spark, cfg, name), lost


def open_table(spark: SparkSession, cfg: JobConfig, name: str) -> DataFrame:
    """A published table, whole: what a killed load had decided is finished first."""
    recover(spark, cfg.path("lake"))
    fmt = "parquet" if name in PARTITIONS else cfg.dims_fmt
    return read_table(spark, name, cfg.table(name), fmt)


def open_views(spark: SparkSession, cfg: JobConfig) -> None:
    """Every published table as a temporary view of its name, for `spark.sql`."""
    for name in TABLES:
        open_table(spark, cfg, name).createOrReplaceTempView(name)
    for name in SIDE_TABLES:
        open_table(spark, cfg, name).createOrReplaceTempView(name)


def tidy_lake(spark: SparkSession, cfg: JobConfig) -> int:
    """Remove what killed loads left beside the tables; how many there were."""
    return remove_abandoned(spark, cfg.path("lake"), cfg.abandoned_hours)


def check_lake(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """Report over every published table."""
    return quality_report(
        {name: open_table(spark, cfg, name) for name in TABLES}, cfg.as_of)


def run_all(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """Labels, demographics, fact and calendar; then the report over all of them."""
    load_labels(spark, cfg)
    load_demographics(spark, cfg)
    load_fact(spark, cfg)
    load_calendar(spark, cfg)
    return check_lake(spark, cfg)
