"""A fact laid out for joins with a dimension that is too large to broadcast.

The fact is shuffled once, when it is written: into buckets by the key of one link. A
join with that link's dimension then reads the fact bucket by bucket and shuffles the
dimension alone, however often it is asked.

A key with more rows than an even bucket holds is dealt to several parts, each hashed
to a bucket of its own, and the dimension's row goes to each of them. There are fewer
such keys than buckets and fewer than two parts a bucket in all, so what is noted of
them is bounded by the number of buckets, whatever the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from portolan.operators.star import LINKS
from portolan.sinks.publish import Publication, recover

PART = "_part"
_LAYOUT = "link string, buckets int, ddl string, spread array<struct<key: string, parts: int>>"


def spread_of(fact: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, parts) of the keys, NULL among them, with more rows than an even bucket."""
    counted = fact.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") * buckets / F.lit(fact.count())).cast("int")
    return counted.select("key", parts.alias("parts")).where("parts > 1")


def save_clustered(fact: DataFrame, path: str, link: str, buckets: int) -> None:
    """Replace the table at `path` by `fact` in buckets by the key of a link, and beside
    it `<path>_layout`, which says how; both or none.

    `fact` should be read from files: rows of a spread key are dealt by their place, and
    so equal rows spread as well. An empty fact gives an empty table. A column named
    `_part` is refused.
    """
    spark, key = fact.sparkSession, LINKS[link].fact_key
    if PART in fact.columns:
        raise ValueError(f"the fact has a column {PART} of its own")
    found = spread_of(fact, key, buckets).select(F.col("key").cast("string").alias("key"), "parts").collect()
    spread = spark.createDataFrame(found, "key string, parts int").select(
        F.col("key").cast(fact.schema[key].dataType).alias("_key"), "parts")
    numbered = fact.withColumn(PART, F.monotonically_increasing_id())
    dealt = numbered.join(F.broadcast(spread), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        PART, F.pmod(PART, F.coalesce("parts", F.lit(1))).cast("int")).select(*fact.columns, PART)
    layout = spark.createDataFrame(
        [(link, buckets, dealt.schema.toDDL(), found)], _LAYOUT)
    with Publication(spark) as publication:
        staged = publication.stage(path)
        table = f"portolan_{uuid.uuid4().hex}"
        try:
            dealt.repartition(buckets, key, PART).write.bucketBy(buckets, key, PART).sortBy(
                key, PART).option("path", staged).saveAsTable(table, format="parquet")
        finally:
            spark.sql(f"drop table if exists {table}")
        layout.coalesce(1).write.parquet(publication.stage(f"{path}_layout"))
        publication.commit()


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    recover(spark, path.rstrip("/").rpartition("/")[0])
    layout = spark.read.schema(_LAYOUT).parquet(f"{path}_layout").first().asDict(recursive=True)
    key, table = LINKS[layout["link"]].fact_key, f"portolan_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    # The catalog is only asked what the buckets are: the entry goes, the files stay.
    spark.sql(f"create table {table} ({layout['ddl']}) using parquet clustered by ({key}, {PART}) "
              f"sorted by ({key}, {PART}) into {layout['buckets']} buckets location '{place}'")
    try:
        return spark.table(table), layout
    finally:
        spark.sql(f"drop table {table}")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a clustered table, as they were saved."""
    return _opened(spark, path)[0].drop(PART)


def clustered_join(spark: SparkSession, path: str, dims: dict[str, DataFrame],
                   how: str = "left") -> DataFrame:
    """The rows of a clustered table with the labels of the link it is clustered by.

    A merge join of bucket with bucket: the fact is not shuffled and no side is broadcast,
    so the dimension may be of any size. Rows with an unknown or NULL key have NULL labels
    (`how="inner"`: are left out). One that is small enough is broadcast by
    `star_join` without this layout.
    """
    fact, layout = _opened(spark, path)
    link = LINKS[layout["link"]]
    spread = spark.createDataFrame(
        [(s["key"], s["parts"]) for s in layout["spread"]], "key string, parts int").select(
        F.col("key").cast(fact.schema[link.fact_key].dataType).alias("_hot"), "parts")
    rows = dims[link.table].select(
        F.col(link.table_key).alias("_key"), *[F.col(c).alias(n) for c, n in link.labels.items()])
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    dealt = rows.join(F.broadcast(spread), F.col("_key") == F.col("_hot"), "left").select(
        *rows.columns, F.explode(parts).alias("_of"))
    return fact.join(
        dealt.hint("merge"), (F.col(link.fact_key) == F.col("_key")) & (F.col(PART) == F.col("_of")), how
    ).drop("_key", "_of", PART)
