"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from portolan.scratch import new_folder, shared_folder

# The ASCII white space that separates words, and a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Cuts the lineage: what a lost executor held is read again, not computed again.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame, **derived: Column) -> DataFrame:
    """(row, *derived): the input row as one struct, so that no derived column can
    clash with a column of the input. `row.*` gives the input back."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in derived.items()])


def blanked(text: Column) -> Column:
    """Every white-space character as one blank."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))


def words(text: Column) -> Column:
    """The words of a text, in order; a NULL text has none."""
    return F.array_remove(F.split(blanked(text), " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, though `body` uses it in loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*parts: Column) -> Column:
    """An even draw from [0, 1) that is the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once per application, so that Python tasks
    can import it whatever folder and path the application was started with."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(root)
    # Not in a run's scratch: executors that join later fetch it too.
    folder = f"{shared_folder(spark)}/portolan/lib-{uuid.uuid4().hex}"
    files, path = shared_files(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{package}.zip", compression=None) as target, \
            zipfile.ZipFile(target, "w") as archive:
        for place, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(place, name)
                    archive.write(source, os.path.join(package, os.path.relpath(source, root)))
    context.addPyFile(f"{folder}/{package}.zip")
    _shipped.add(context)


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """`df.mapInArrow`, with this library at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def chunked(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Tuples in schema order, as record batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


def shared_files(folder: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, for a folder that all executors share.

    Any store that Spark's checkpoint folder can name and Arrow can open: a
    mounted folder, `hdfs:`, `s3:` or `gs:`.
    """
    for spark_scheme, scheme in (("s3a://", "s3://"), ("s3n://", "s3://"), ("gcs://", "gs://")):
        if folder.startswith(spark_scheme):
            folder = scheme + folder.removeprefix(spark_scheme)
    return pafs.FileSystem.from_uri(folder)


def put_in_place(files: pafs.FileSystem, begun: str, name: str) -> None:
    """Give a file that is whole its name. One that a lost attempt of the same task has
    left there holds the same and goes: not every store renames onto a file."""
    if files.get_file_info(name).type != pafs.FileType.NotFound:
        files.delete_file(name)
    files.move(begun, name)
