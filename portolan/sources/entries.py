"""Raw entry records from parquet or CSV, under one explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from portolan.schemas import CORRUPT, CSV, RAW_ENTRIES


def read_entries(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """29 raw columns. No inference job runs.

    CSV lines that do not fit the schema keep what could be read and carry the
    whole line in `_corrupt_record`, so they can be counted. That column costs
    the CSV reader its column pruning only in jobs that use it.
    """
    if fmt == "parquet":
        return spark.read.schema(RAW_ENTRIES).parquet(*_paths(path))
    if fmt == "csv":
        with_corrupt = StructType([*RAW_ENTRIES.fields, StructField(CORRUPT, StringType())])
        return (
            spark.read.schema(with_corrupt)
            .options(**CSV)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(_paths(path))
        )
    raise ValueError(f"entries are parquet or csv, not {fmt!r}")


def entry_files(spark: SparkSession, path: str | list[str]) -> Row:
    """(files, bytes, fingerprint) of what `read_entries` reads, from the listing alone:
    the fingerprint changes if a file comes, goes, grows or is written anew."""
    listed = spark.read.format("binaryFile").load(_paths(path))
    mark = F.xxhash64("path", "length", "modificationTime")
    return listed.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(mark)),
                    F.sum(F.xxhash64(mark).cast("decimal(20,0)")).cast("string")).alias("fingerprint")).first()


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)
