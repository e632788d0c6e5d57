"""Published tables, read back under their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portolan.schemas import CSV, SIDE_TABLES, TABLES
from portolan.scratch import file_system


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Columns come in contract order: partition columns are not moved last. A side table
    that nothing was written to yet is empty."""
    contract = {**TABLES, **SIDE_TABLES}[name]
    if name in SIDE_TABLES:
        files, place = file_system(spark, path)
        if not files.exists(place):
            return spark.createDataFrame([], contract)
    reader = spark.read.schema(contract)
    if fmt == "csv":
        reader = reader.options(**CSV)
    return reader.load(path, format=fmt).select(*contract.fieldNames())
