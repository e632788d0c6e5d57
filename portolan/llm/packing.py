"""Documents packed into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from portolan.llm.byte_bpe import byte_bpe
from portolan.llm.common import map_arrow

PIECE = "struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint, doc_tokens: bigint>"
WINDOW = f"sequence_id bigint, n_tokens int, tokens binary, pieces array<{PIECE}>"

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("offset", pa.int64()), ("doc_tokens", pa.int64())])
_WINDOW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()),
                     ("tokens", pa.binary()), ("pieces", pa.list_(_PIECE))])
_SENT_AT_ONCE = 512  # windows in one batch to the JVM


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """`k` windows of item numbers with near-equal sums.

    Karmarkar-Karp: every item starts as a partial partition of one used window;
    the two with the largest imbalance (fullest less emptiest window) are merged,
    the full windows of one onto the empty windows of the other, until one is left.
    Ties go by item number. A partial partition holds its used windows only, in
    falling order; the items of a window are a chain (`after`).
    """
    after = np.full(len(sizes), -1, np.int64)
    heap = [(-s, i, np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, number, sums, first, last = heapq.heappop(heap)
        _, _, sums2, first2, last2 = heapq.heappop(heap)
        both = max(0, len(sums) + len(sums2) - k)  # windows that get items of both
        alone = len(sums) - both
        after[last[alone:][::-1]] = first2[:both]
        sums = np.concatenate((sums[:alone], sums[alone:][::-1] + sums2[:both], sums2[both:]))
        first = np.concatenate((first[:alone], first[alone:][::-1], first2[both:]))
        last = np.concatenate((last[:alone], last2[:both], last2[both:]))
        order = np.argsort(-sums, kind="stable")
        sums, first, last = sums[order], first[order], last[order]
        emptiest = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (emptiest - int(sums[0]), number, sums, first, last))
    windows = []
    for item in (heap[0][3].tolist() if heap else []):
        window = []
        while item >= 0:
            window.append(item)
            item = int(after[item])
        windows.append(window)
    return windows


def rising(sizes: list[int], capacity: int, k: int) -> tuple[list[list[int]], list[int]]:
    """Windows of item numbers within `capacity` and what they hold: the differencing for
    `k` windows, and for more as long as one exceeds the capacity: by one more, or at once
    by the share that the fullest has too much."""
    while True:
        windows = differencing(sizes, k)
        loads = [sum(sizes[i] for i in window) for window in windows]
        fullest = max(loads)
        if fullest <= capacity:
            return windows, loads
        k = max(k + 1, min(len(sizes), k * fullest // capacity))


def pack_sizes(sizes: list[int], capacity: int, cut: bool = True,
               rise: list[float] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) within `capacity`, for items within it.

    The window count starts at the least that could hold the items and rises while the
    capacity is exceeded (`rising`). So every item is whole in its window. With `cut`, the
    emptiest windows, as many as the count has risen by, are then dissolved into the
    places that are left in the others. `rise` remembers the share by which the count of
    the last group rose, where that of the next one starts: like groups rise alike.
    """
    if not sizes:
        return []
    least, rise = -(-sum(sizes) // capacity), [0.0] if rise is None else rise
    windows, loads = rising(sizes, capacity, min(len(sizes), max(least, int(least * (1 + rise[0])))))
    rise[0] = 0.9 * max(0, len(windows) - least) / least
    windows = [[(i, 0, sizes[i]) for i in window] for window in windows]
    return _closed_up(windows, loads, capacity, least) if cut else windows


def _closed_up(windows: list[list[tuple[int, int, int]]], loads: list[int], capacity: int,
               least: int) -> list[list[tuple[int, int, int]]]:
    """The `least` fullest windows, with what the others hold cut into their places."""
    order = sorted(range(len(windows)), key=lambda at: (-loads[at], at))
    kept = [(windows[at], capacity - loads[at]) for at in order[:least]]
    left = [piece for at in order[least:] for piece in windows[at]]
    for window, room in reversed(kept):  # the emptiest first, so that few pieces are cut
        while room and left:
            item, start, length = left.pop()
            moved = min(length, room)
            window.append((item, start, moved))
            room -= moved
            if moved < length:
                left.append((item, start + moved, length - moved))
    return [window for window, _ in kept]


def _pack_group(docs: list[tuple[int | None, np.ndarray]], capacity: int, cut: bool,
                rise: list[float]) -> Iterator[tuple[list[dict], np.ndarray]]:
    """(pieces, ids) of each window. Full windows are cut off long documents from
    the front; their rests go to the differencing."""
    rests = []
    for doc_id, ids in docs:
        full = len(ids) // capacity * capacity
        for start in range(0, full, capacity):
            yield ([{"doc_id": doc_id, "start": start, "length": capacity, "offset": 0,
                     "doc_tokens": len(ids)}], ids[start:start + capacity])
        if full < len(ids):
            rests.append((doc_id, full, ids))
    for window in pack_sizes([len(ids) - full for _, full, ids in rests], capacity, cut, rise):
        pieces, parts, offset = [], [], 0
        for item, start, length in window:
            doc_id, full, ids = rests[item]
            pieces.append({"doc_id": doc_id, "start": full + start, "length": length,
                           "offset": offset, "doc_tokens": len(ids)})
            parts.append(ids[full + start:full + start + length])
            offset += length
        if pieces:
            yield pieces, np.concatenate(parts)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1,
                   group_windows: int = 256, cut: bool = True) -> DataFrame:
    """One row per window: `sequence_id`, `n_tokens`, `tokens` (little-endian
    unsigned 32-bit ids, unpadded) and the `pieces` in it.

    Reads `doc_id` and `text` of `docs`; other columns are not touched. Narrow: a
    task encodes its own rows and packs them in groups that fill `group_windows`
    windows, so memory is one group, nothing is shuffled, no key can be hot, and
    a lost task is packed again alike. A group leaves less than one window empty.

    A NULL text is an empty one; every document ends in `end_id`, so an empty one
    still has one token. Documents longer than a window are cut. Repeated rows are
    packed each. No rows give no windows. A NULL `doc_id` stays NULL in its pieces.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        end = np.array([end_id], encoder.dtype)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, np.ndarray]] = []
        size, rise = 0, [0.0]
        out: list[tuple] = []

        def flush() -> None:
            nonlocal sequence
            for pieces, ids in _pack_group(held, capacity, cut, rise):
                out.append((sequence, len(ids), ids.astype("<u4").tobytes(), pieces))
                sequence += 1

        def send(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) > least:
                part = out[:_SENT_AT_ONCE]
                del out[:_SENT_AT_ONCE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*part), _WINDOW)], schema=_WINDOW)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                ids = np.concatenate((ids, end))
                held.append((doc_id, ids))
                size += len(ids)
                if size >= group_windows * capacity:
                    flush()
                    held, size = [], 0
                    yield from send(_SENT_AT_ONCE)
        flush()
        yield from send(0)

    return map_arrow(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), pack, WINDOW)


def pieces_of(windows: DataFrame) -> DataFrame:
    """One row per piece, with the checksum of its ids."""
    piece = F.col("piece")
    ids = F.substring("tokens", (piece.offset * 4 + 1).cast("int"), (piece.length * 4).cast("int"))
    return windows.select("sequence_id", "tokens", F.explode("pieces").alias("piece")).select(
        piece.doc_id.alias("doc_id"), piece.start.alias("start"), piece.length.alias("length"),
        F.crc32(ids).alias("ids_crc32"), piece.doc_tokens.alias("doc_tokens"),
        "sequence_id", piece.offset.alias("offset"))
