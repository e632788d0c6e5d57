"""Scratch folders that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Folders of the runs that are going on, the innermost last.
_RUNS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Only a local session may fall back to a folder of this machine; on a
    cluster an unset folder is an error, since executors could not read it.
    Checkpoints are pointed at the same place.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="portolan-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses; within `run_scratch`,
    under the folder of that run."""
    within = _RUNS[-1] if _RUNS else f"{shared_folder(spark)}/portolan"
    return f"{within}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """All scratch made in here lies in one folder, removed at the end, failed or not.

    What was read from it must be published or collected before.
    """
    folder = new_folder(spark, label)
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        remove(spark, folder)


@contextmanager
def scratch_in(folder: str) -> Iterator[None]:
    """Scratch made in here lies in `folder`, which stays: whoever named it removes it."""
    _RUNS.append(folder)
    try:
        yield
    finally:
        _RUNS.remove(folder)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path that Spark can open."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this library's own making and all in it, if it is there."""
    files, place = file_system(spark, folder)
    files.delete(place, True)
