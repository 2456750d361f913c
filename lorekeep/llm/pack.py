"""Filling containers of fixed capacity, by bounded-space online packing.

Each partition keeps at most `open_bins` windows open. An item goes to the window in which it fits best; where it fits in none
and all are open, the fullest is closed; a full one is closed at once. What is open at the end of a partition is left over: the items of leftover windows are
gathered in fewer partitions, largest first, and packed again until one partition remains. No item order or
size is collected; a level's leftovers are at most open_bins windows per partition of the level before. Every level is a written
table, so a window that was closed once stays as it is if an executor is lost.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

CAPACITY, OPEN_BINS = 8192, 1024
#: Leftover windows that one task packs again, as a multiple of the open windows.
MERGE = 16


class _Bins:
    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next = capacity, most, first_id
        self.room: list[tuple[int, int]] = []  # (room, container), sorted
        self.held: dict[int, list[tuple]] = {}
        self.closed: list[tuple[int, int, list[tuple]]] = []

    def put(self, item: tuple, tokens: int) -> None:
        i = bisect_left(self.room, (tokens, -1))
        if i < len(self.room):
            room, bin_ = self.room.pop(i)
        else:
            if len(self.room) >= self.most:
                self._close(*self.room.pop(0))
            room, bin_ = self.capacity, self.next
            self.next += 1
            self.held[bin_] = []
        self.held[bin_].append(item)
        if room == tokens:
            self._close(0, bin_)
        else:
            insort(self.room, (room - tokens, bin_))

    def _close(self, room: int, bin_: int) -> None:
        self.closed.append((bin_, self.capacity - room, self.held.pop(bin_)))

    def take(self) -> list[tuple[int, int, list[tuple]]]:
        out, self.closed = self.closed, []
        return out

    def left(self) -> list[tuple[int, int, list[tuple]]]:
        return [(b, self.capacity - room, self.held[b]) for room, b in self.room]


def cut_text(data: bytes, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, bytes) of the parts of an oversized text, each within the capacity, the last with room for the end token."""
    at = 0
    while len(data) - at + 1 > capacity:
        end = min(at + capacity, len(data) - 1)
        while end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield at, end - at
        at = end
    yield at, len(data) - at


def _rows(bins: list, is_open: bool, key: pa.DataType) -> pa.RecordBatch:
    items = [i for b in bins for i in b[2]]
    offsets = [0]
    for b in bins:
        offsets.append(offsets[-1] + len(b[2]))
    columns = [pa.array([i[c] for i in items], t) for c, t in enumerate((key, pa.int32(), pa.int64(), pa.int32()))]
    packed = pa.StructArray.from_arrays(columns, ["id", "piece", "start", "tokens"])
    return pa.RecordBatch.from_arrays(
        [pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.int32()), pa.array([is_open] * len(bins), pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), packed)],
        ["container", "fill", "open", "items"],
    )


def _pack(capacity: int, open_bins: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, kind = _Bins(capacity, open_bins, (level << 56) | (TaskContext.get().partitionId() << 32)), None
        for b in batches:
            kind = b.column(0).type
            for i, (key, tokens, piece, start) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                if tokens <= capacity:
                    bins.put((key, piece, start, tokens), tokens)
                    continue
                data = b.column(4)[i].as_py().encode("utf-8", "surrogatepass")
                for n, (at, size) in enumerate(cut_text(data, capacity)):
                    size += at + size == len(data)
                    bins.put((key, n, at, size), size)
            if closed := bins.take():
                yield _rows(closed, False, kind)
        if left := bins.left():
            yield _rows(left, True, kind)

    return run


def pack(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """container, fill, items (array of id, piece, start, tokens): every row's text in one container, or cut if it alone exceeds one.

    Sizes are tokens of ByT5: one per UTF-8 byte and one end token, counted from the text. Pieces of a cut text are numbered from 0 and start
    at byte `start`, shifted to whole characters. A null text counts as an empty one (one token). Repeated rows are items of their own; a null key
    stays null; an empty table gives no containers. Further columns are not read.
    """
    tokens = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    kind = docs.schema[key].dataType.simpleString()
    out = f"container bigint, fill int, open boolean, items array<struct<id: {kind}, piece: int, start: bigint, tokens: int>>"
    sized = docs.select(
        F.col(key).alias("id"), tokens.alias("tokens"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"),
        F.when(tokens > capacity, F.col(text)).alias("text"),
    )
    packed, level = materialise(sized.mapInArrow(_pack(capacity, open_bins, 0), out), "packed-0"), 0
    levels = []
    while True:
        levels.append(packed.where("NOT open"))
        left = packed.where("open")
        n = left.count()
        if not n:
            break
        level += 1
        parts = -(-n // (open_bins * MERGE))
        items = left.select(F.inline("items")).select("id", "tokens", "piece", "start", F.lit(None).cast("string").alias("text"))
        # one partition of at most MERGE * open_bins windows to end with; before that, fewer by a factor of MERGE each time
        items = items.repartition(parts, F.xxhash64("id", "piece", "start")).sortWithinPartitions(F.desc("tokens"), "id", "piece")
        again = items.mapInArrow(_pack(capacity, open_bins if parts > 1 else 1 << 30, level), out)
        packed = materialise(again if parts > 1 else again.withColumn("open", F.lit(False)), f"packed-{level}")
    all_ = levels[0]
    for x in levels[1:]:
        all_ = all_.unionByName(x)
    return all_.drop("open")
