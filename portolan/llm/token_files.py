"""Token ids in flat unsigned files with 64-bit document offsets, memory-mapped.

A shard is three files of plain little-endian numbers:

    shard-00007.u16   uint16   the ids of its documents, one after the other; .u32 with
                               uint32 where the vocabulary has over 65,536 ids
    shard-00007.off   int64    where each document starts among them; one more: the end
    shard-00007.doc   int64    the documents' ids (lowest int64: NULL)

Shards follow each other in ascending `doc_id`. How many ids lie in earlier shards
is a prefix sum over shard sizes: one row per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from portolan.llm.byte_bpe import byte_bpe
from portolan.llm.common import chunked, map_arrow, put_in_place, shared_files, written

NO_DOC = -(1 << 63)
SHARD = "shard int, docs bigint, ids bigint, kind string"
_SHARD = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()),
                    ("kind", pa.string())])
ENTRY = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_ENTRY = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                    ("ids_crc32", pa.int64())])


def shard_name(path: str, shard: int, kind: str) -> str:
    return f"{path}/shard-{shard:05d}.{kind}"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode `doc_id`, `text` into shards under `folder`; gives (shard, docs, ids, kind, base).

    Documents are range-partitioned on `doc_id`; equal ids (NULLs first) go by text
    hash and place, so no id can fill one task. Partition p writes shard p: under a
    name of its own attempt, moved in place when whole, so a task that runs twice
    leaves one shard. A NULL text is an empty one; each document ends in `end_id`.
    An empty table gives no shards.
    """
    doc_id = F.col("doc_id").cast("bigint")
    ordered = (
        docs.select(doc_id.alias("doc_id"), "text")
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_hash", "_place")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash", "_place")
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        ids_kind = f"u{8 * encoder.dtype.itemsize}"
        fs, path = shared_files(folder)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        offsets, doc_ids, size = [0], [], 0
        with ExitStack() as open_files:
            ids_file = None
            for batch in batches:
                for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                    if doc == NO_DOC:
                        raise ValueError("the lowest 64-bit number stands for a missing doc_id")
                    if ids_file is None:
                        fs.create_dir(path, recursive=True)
                        ids_file = open_files.enter_context(fs.open_output_stream(
                            shard_name(path, shard, f"{ids_kind}.{attempt}")))
                    ids_file.write(ids.tobytes() + end)
                    size += len(ids) + 1
                    offsets.append(size)
                    doc_ids.append(NO_DOC if doc is None else doc)
        if not doc_ids:
            return
        for kind, numbers in (("off", offsets), ("doc", doc_ids)):
            with fs.open_output_stream(shard_name(path, shard, f"{kind}.{attempt}")) as out:
                out.write(np.array(numbers, "<i8").tobytes())
        for kind in (ids_kind, "off", "doc"):
            put_in_place(fs, shard_name(path, shard, f"{kind}.{attempt}"),
                         shard_name(path, shard, kind))
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "docs": len(doc_ids), "ids": size, "kind": ids_kind}],
            schema=_SHARD)

    shards = written(map_arrow(ordered, write, SHARD), "shards")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def _numbers(fs: pafs.FileSystem, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped, where the store is a mounted folder."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype, mode="r")
    with fs.open_input_file(name) as source:
        return np.frombuffer(source.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    `start` counts the ids of all documents before; the checksum is over 32-bit ids
    whatever the file holds. A document's ids are a slice of the mapped file.
    """
    n = shards.count()
    if n == 0:
        return spark.createDataFrame([], ENTRY)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for shard, kind, base in zip(*(batch[c].to_pylist()
                                               for c in ("shard", "kind", "base"))):
                    ids = _numbers(fs, shard_name(path, shard, kind), f"<u{int(kind[1:]) // 8}")
                    offsets = _numbers(fs, shard_name(path, shard, "off"), "<i8")
                    doc_ids = _numbers(fs, shard_name(path, shard, "doc"), "<i8")
                    for i, doc in enumerate(doc_ids.tolist()):
                        start, end = int(offsets[i]), int(offsets[i + 1])
                        yield (None if doc == NO_DOC else doc, base + start, end - start,
                               zlib.crc32(ids[start:end].astype("<u4")))

        yield from chunked(rows(), _ENTRY, 10_000)

    # One row per shard, in as many tasks: the list of files, not data.
    listed = shards.select("shard", "kind", "base").repartition(n, "shard")
    return map_arrow(listed, read, ENTRY)
