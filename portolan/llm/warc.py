"""WARC archives as a chunked record table: (record, chunk number) rows with running digests."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from portolan.llm.common import chunked, map_arrow, put_in_place, shared_files, written

CHUNK = 256 * 1024
RECORD_DATE = "2020-01-01T00:00:00Z"  # used where a page has no date of its own
NO_ID = "none"

# One row per chunk of a payload. `bytes_so_far` and `digest_so_far` cover the chunks
# up to this one, so the row marked `last` has those of the whole payload.
CHUNK_ROW = ("page_id bigint, record_type string, refers_to bigint, declared_digest string, "
             "declared_bytes bigint, chunk_no int, chunk binary, bytes_so_far bigint, "
             "digest_so_far string, last boolean")
_CHUNK_ROW = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int32()),
    ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
    ("last", pa.bool_())])
_ARCHIVE = "archive string, records bigint"


def base32(sha1_hex: str | bytes) -> str:
    raw = bytes.fromhex(sha1_hex) if isinstance(sha1_hex, str) else sha1_hex
    return base64.b32encode(raw).decode()


# Records

def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, record_type, refers_to) of each page.

    Of pages with equal payloads of at least `min_bytes`, the one with the largest
    `page_id` is a response and the others revisit it. The digests are grouped first
    (partial maxima before the shuffle); the join back to the pages is a plain
    equi-join, which Spark splits where one payload has a third of the rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.length(payload).cast("bigint").alias("payload_bytes"),
        F.sha1(payload).alias("sha1"))
    largest = page.where(F.col("payload_bytes") >= min_bytes).groupBy(
        F.col("sha1").alias("_sha1")).agg(F.max("page_id").alias("_response"))
    revisit = F.col("page_id").isNull() & F.col("_response").isNotNull() | (
        F.col("page_id") < F.col("_response"))
    return page.join(largest, F.col("sha1") == F.col("_sha1"), "left").select(
        *page.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_response")).alias("refers_to"))


def chunk_rows(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a response's payload; a revisit or empty payload has one
    empty chunk. `parts` is the number of chunks."""
    stored = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(
        F.lit("").cast("binary"))
    parts = F.greatest(F.lit(1), F.ceil(F.length(stored) / chunk)).cast("int")
    return (
        recs.withColumns({"payload": stored, "parts": parts})
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("chunk", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
        .drop("payload")
    )


# Writing

def _urn(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def _line(text: str | None) -> str:
    """A header value: white space and control characters would end it early."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _headers(row: dict) -> tuple[bytes, bytes]:
    """The record's header block, and the HTTP header block before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    kept = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}",
        f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {_line(row['url'])}",
        f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}"]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + kept}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http.encode()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk: int = CHUNK,
                   level: int = 6) -> DataFrame:
    """Write one gzip-compressed archive per task under `folder`; gives (archive, records).

    A page (`page_id`, `url`, `html`) is one record and one gzip member, streamed
    chunk by chunk. NULL html is an empty payload, a NULL url an empty one, a NULL
    `page_id` is written as `none`. Repeated rows are written each; of rows equal in
    `page_id` and payload all are responses or all revisits. No pages, no archives.

    An archive is written under the name of its attempt and moved in place when
    whole, so a task that runs twice leaves one.
    """
    rows = chunk_rows(records(pages, min_bytes), chunk).select(
        "page_id", "url", "payload_bytes", "sha1", "record_type", "refers_to", "parts",
        "chunk_no", "chunk")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():05d}.warc.gz"
        begun, out, count = f"{name}.{task.taskAttemptId()}", None, 0
        try:
            for batch in batches:
                heads = batch.select(
                    [n for n in batch.schema.names if n != "chunk"]).to_pylist()
                for head, payload in zip(heads, batch["chunk"]):
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(begun, compression=None)
                    if head["chunk_no"] == 0:
                        packer = zlib.compressobj(level, wbits=31)
                        for block in _headers(head):
                            out.write(packer.compress(block))
                    out.write(packer.compress(payload.as_buffer()))
                    if head["chunk_no"] == head["parts"] - 1:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        count += 1
        finally:
            if out is not None:
                out.close()
        if count:
            put_in_place(fs, begun, name)
            yield pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]],
                                              "records": [count]})

    return written(map_arrow(rows, write, _ARCHIVE), "archives")


# Reading

class _Plain:
    """The bytes of an archive, decompressed as they are asked for."""

    def __init__(self, source):
        self.source, self.unpacker, self.held = source, None, b""
        self.raw = b""

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                return False
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(wbits=31)
        self.held += self.unpacker.decompress(self.raw, CHUNK)
        if self.unpacker.eof:
            self.raw, self.unpacker = self.unpacker.unused_data, None
        else:
            self.raw = self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes up to and with `mark`; empty at the end of the archive."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a header")
                return b""
        found, self.held = self.held[:at + len(mark)], self.held[at + len(mark):]
        return found

    def some(self, most: int) -> bytes:
        while len(self.held) < most and self.more():
            pass
        found, self.held = self.held[:most], self.held[most:]
        return found


def _fields(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if line)


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == NO_ID else int(name)


def _chunks(source, chunk: int) -> Iterator[tuple]:
    plain = _Plain(source)
    while head := plain.until(b"\r\n\r\n"):
        fields = _fields(head)
        http = plain.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http)
        kind = fields["WARC-Type"]
        declared = int(_fields(http)["Content-Length"])
        refers_to = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
        digest, seen, number = hashlib.sha1(), 0, 0
        while True:
            data = plain.some(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("the archive ends within a payload")
            digest.update(data)
            seen, left = seen + len(data), left - len(data)
            yield (_page(fields["WARC-Record-ID"]), kind, refers_to,
                   fields["WARC-Payload-Digest"].removeprefix("sha1:"), declared, number, data,
                   seen, base32(digest.copy().digest()), left == 0)
            number += 1
            if left == 0:
                break
        if plain.some(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame,
                  chunk: int = CHUNK) -> DataFrame:
    """The archives as chunk rows (see CHUNK_ROW), one task per few archives.

    Memory is one chunk and what is decompressed of the next, never a whole record.
    Raises on an archive that is cut short.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch["archive"].to_pylist():
                    with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                        yield from _chunks(source, chunk)

        yield from chunked(rows(), _CHUNK_ROW, max(1, (32 << 20) // chunk))

    n = max(1, archives.count())
    return map_arrow(archives.select("archive").repartition(n, "archive"), read, CHUNK_ROW)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record: what its last chunk row says of the whole payload.

    A revisit holds no payload; its size and digest are those its headers declare.
    A response whose payload is not what its headers declare raises.
    """
    response = F.col("record_type") == "response"
    wrong = response & ((F.col("digest_so_far") != F.col("declared_digest"))
                        | (F.col("bytes_so_far") != F.col("declared_bytes")))
    return chunks.where("last").select(
        "page_id",
        F.when(wrong, F.raise_error(F.concat(
            F.lit("payload differs from its header: page "), F.col("page_id").cast("string"))))
        .when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes"))
        .cast("bigint").alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(
            F.col("declared_digest")).alias("payload_digest"),
        "record_type", "refers_to")
