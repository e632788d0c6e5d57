"""`spark-submit run_job.py JOB --lake PATH ...`: run one job, or all."""

from __future__ import annotations

import argparse
import datetime
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession

from portolan.operators.quality import refuse
from portolan.plans import jobs


def show(rows: list[Row]) -> None:
    """Print a report whole; it has a few rows, whatever the data."""
    for row in rows:
        print("  ".join(f"{name}={value}" for name, value in row.asDict().items()))


def show_and_gate(report: DataFrame) -> None:
    """Print the whole report, then fail the run if a check failed."""
    rows = report.collect()
    show(rows)
    refuse(rows)


def load_and_show_losses(load: Callable, spark: SparkSession, cfg: jobs.JobConfig) -> None:
    """Load, then print every column that lost values in typing."""
    _, losses = load(spark, cfg)
    show(losses.where("rejected > 0").collect())


JOBS = {
    "fact": partial(load_and_show_losses, jobs.load_fact_and_losses),
    "calendar": jobs.load_calendar,
    "labels": jobs.load_labels,
    "demographics": partial(load_and_show_losses, jobs.load_demographics_and_losses),
    "rejects": lambda spark, cfg: show(jobs.entry_rejects(spark, cfg).collect()),
    "check": lambda spark, cfg: show_and_gate(jobs.check_lake(spark, cfg)),
    "tidy": lambda spark, cfg: print(f"removed={jobs.tidy_lake(spark, cfg)}"),
    "all": lambda spark, cfg: show_and_gate(jobs.run_all(spark, cfg)),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="portolan", description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--lake", required=True, help="folder of the published tables")
    parser.add_argument("--entries", default="")
    parser.add_argument("--entries-fmt", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--entries-by-month", action="store_true",
                        help="each input file holds one month: write without a shuffle")
    parser.add_argument("--labels", default="")
    parser.add_argument("--labels-one-text", action="store_true",
                        help="the label files are one text, in the order of their names")
    parser.add_argument("--demographics", default="")
    parser.add_argument("--dims-fmt", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--replace-all", action="store_true",
                        help="the input is the whole table: drop the months it lacks")
    parser.add_argument("--again", action="store_true",
                        help="load entries again that the ledger has as they are")
    parser.add_argument("--abandoned-hours", type=float, default=72,
                        help="age at which `tidy` removes what a killed load left")
    parser.add_argument("--as-of", type=datetime.date.fromisoformat)
    parser.add_argument("--param", action="append", default=[], metavar="NAME=VALUE",
                        help="fills {NAME} in the paths")
    args = vars(parser.parse_args(argv))
    job = JOBS[args.pop("job")]
    args["params"] = dict(item.split("=", 1) for item in args.pop("param"))
    spark = SparkSession.builder.appName("portolan").getOrCreate()
    job(spark, jobs.JobConfig(**args))


if __name__ == "__main__":
    main()
