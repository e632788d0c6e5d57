"""Dense surrogate keys 0..n-1 without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StructField, StructType

from portolan.scratch import new_folder


def _content(df: DataFrame) -> Column:
    """Hash of a row's content; a map, which has no order, by its sorted entries."""
    return F.xxhash64(*[
        F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType)
        else F.col(f"`{f.name}`") for f in df.schema])


def dense_index(df: DataFrame, order_by: list[str], name: str,
                from_files: bool = False) -> DataFrame:
    """Add `name`: the row's place, from 0, in the order of `order_by`.

    A range-partitioned sort spreads the rows; each row notes its partition and
    its place in it; the noted rows are written once to the shared folder, so a
    lost executor cannot renumber them; partition counts (one row per partition)
    give each partition its offset. The folder goes with the run (`run_scratch`).

    Rows equal in `order_by` follow their content hash, and fully equal rows
    their input place, so one hot key value still spreads over many partitions.
    Which of two fully equal rows comes first makes no difference to the result.
    A task that runs again must send the same rows to the same partitions: rows read
    straight from files come in the same order again (`from_files`); any other input
    is sorted within its tasks first, once for the sort's sample and once for the sort.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    rows = df.select(F.struct("*").alias("row"), _content(df).alias("content"))
    if not from_files:
        rows = rows.sortWithinPartitions("content")
    (
        rows.withColumn("input", F.monotonically_increasing_id())
        .orderBy(*[F.col("row")[c] for c in order_by], "content", "input")
        .select("row", F.spark_partition_id().alias("part"),
                F.monotonically_increasing_id().alias("id"))
        .withColumn("place", F.col("id") - F.shiftleft(F.col("part").cast("bigint"), 33))
        .drop("id")
        .write.parquet(path)
    )
    noted = StructType([StructField("row", df.schema, False), StructField("part", IntegerType()),
                        StructField("place", LongType())])
    placed = spark.read.schema(noted).parquet(path)
    # One row per sort partition, at most `spark.sql.shuffle.partitions` of them: the
    # running sum is over task counts, and the broadcast does not grow with the data.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part").agg(F.count("*").alias("rows"))
        .select(F.col("part").alias("of"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    )
    return placed.join(F.broadcast(offsets), F.col("part") == F.col("of")).select(
        "row.*", (F.col("offset") + F.col("place")).alias(name))
