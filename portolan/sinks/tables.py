"""Table writers. Each writes beside the published table and swaps it in when whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from portolan.schemas import CSV
from portolan.sinks.publish import Publication


def save_partitioned(df: DataFrame, path: str, by: list[str], gather: bool = True) -> None:
    """Write parquet in folders per `by` to a path that does not exist yet.

    `gather` brings the rows of one folder together first, so files come out
    whole; Spark splits a folder that is too big for one task and merges small
    ones. Leave it off when the input already comes folder by folder (a monthly
    file): then nothing is shuffled.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in by]) if gather else df
    rows.write.partitionBy(*by).parquet(path)


def save_flat(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an unpartitioned table to a new path; no index column is ever added."""
    writer = df.write.options(**CSV) if fmt == "csv" else df.write
    writer.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], reload: bool = False,
                      gather: bool = True) -> None:
    """Replace a partitioned table; with `reload`, only the folders `df` has rows for.

    A write that fails leaves the table as it was.
    """
    with Publication(df.sparkSession) as publication:
        save_partitioned(df, publication.stage(path, parts_only=reload), by, gather)
        publication.commit()


def write_flat(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace an unpartitioned table. A write that fails leaves it as it was."""
    with Publication(df.sparkSession) as publication:
        save_flat(df, publication.stage(path), fmt)
        publication.commit()
