"""Code-label texts: `;`-ended blocks, one row per block, or line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from portolan.schemas import CSV, LABEL_STAGING


def read_label_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, block) of one or many label files; tabs and line ends survive."""
    return spark.read.text(path, lineSep=";").select(
        _named(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("block"))


def read_label_lines(spark: SparkSession, path: str | list[str], one_text: bool = False) -> DataFrame:
    """(source, file, split, at, line) of label files of any size: a row is a line.

    `split` and `at` rise along a file, so the lines of a `source` are in order by file,
    split and place. A source is a file; with `one_text` the files together are one text,
    in the order of their names.
    """
    at = F.col("_metadata")
    return spark.read.text(path).select(
        F.lit("all files") if one_text else _named(at.file_path), _named(at.file_path),
        at.file_block_start, F.monotonically_increasing_id(), "value",
    ).toDF("source", "file", "split", "at", "line")


def _named(path: Column) -> Column:
    """A local path has one slash or three after its scheme, by who names it."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def label_files(spark: SparkSession, path: str | list[str], one_text: bool = False) -> DataFrame:
    """(source) of every label file, the empty ones too, which have no row to be seen
    by. From the file listing; nothing is read."""
    listed = ["all files"] if one_text else spark.read.text(path).inputFiles()
    return spark.createDataFrame([(name,) for name in listed], "source string").select(
        _named(F.col("source")).alias("source"))


def read_label_staging(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(code, value, type); `type` is a partition folder in parquet."""
    if fmt == "csv":
        return spark.read.schema(LABEL_STAGING).options(**CSV).csv(path)
    return spark.read.schema(LABEL_STAGING).load(path, format=fmt).select(
        *LABEL_STAGING.fieldNames())
