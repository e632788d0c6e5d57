"""City demographics: delimited text with a header, columns found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql.types import StringType, StructField, StructType

from portolan.functions.text import header_name
from portolan.schemas import CORRUPT, CSV


def read_demographics(spark: SparkSession, path: str | list[str], sep: str = ";") -> DataFrame:
    """All columns as text under normalised names; types are applied later.

    Only the header line decides the names, no value is inferred, and files
    whose header differs from the first one are refused. Lines with too few or too
    many fields keep what could be read and carry the whole line in
    `_corrupt_record`, so they can be counted: a line is read whole whatever columns
    are wanted, or its number of fields would not be seen.
    """
    reader = spark.read.options(**CSV).option("sep", sep).option("enforceSchema", False)
    names = reader.csv(path, inferSchema=False).columns
    as_text = StructType([StructField(name, StringType()) for name in [*names, CORRUPT]])
    raw = (
        reader.schema(as_text).option("mode", "PERMISSIVE").option("columnPruning", False)
        .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    )
    return raw.toDF(*[header_name(name) for name in names], CORRUPT)
