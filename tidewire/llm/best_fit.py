"""Best-fit packing of documents into windows by large-item matching.

A document's tokens, with the end token behind them, stay whole unless they exceed the capacity; longer ones are cut from the back into
full windows, so that only the first piece may be shorter.  A piece above one third of the capacity is large: no window holds three.

1. **Matching.**  From the longest on, a large piece takes the longest other large piece that still fits, which leaves as many pairs as
   there can be.
2. **Best fit.**  The smaller pieces, the longest first, go where the gap that they leave is the smallest; a window opens only when no gap
   will do.

What is matched is not rows but lengths: the plan needs the number of pieces of each length only, one row for each of at most
``capacity`` lengths, whatever the size of the table.  Windows in the same state are one range of window numbers, and a step moves as
many pieces of one length as the range takes, so the plan has a few ranges for each length and is the same as if all pieces of
the table had been packed one by one in one place.  Each piece then finds its window from its length and its number among the pieces of that length.

Pieces are written to the shared folder without their ids.  A task numbers its own pieces of each length; the numbers of the tasks before it
are added by a running sum over (length, task) counts.  So no length gathers in one task, however frequent it is.

Results for odd input: a null or empty text is the end token alone; repeated rows are packed like any others, each with a place of its
own; an empty table gives an empty table; a null key stays null; ties go by the order of tasks and rows; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.bpe import library_encoder, read_spec
from tidewire.llm.shared import slices, text_of
from tidewire.staging import staged

#: Lengths below this leave the number of a piece among those of its length in one long, beside the length.
LONGEST = 1 << 20
RANK_BITS = 42


class Gaps:
    """Ranges of windows by the gap that is left in each: all windows of a range hold the same tokens so far."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.gaps: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.ranges:
                bisect.insort(self.gaps, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A range (gap, first, n) of the smallest gap that takes ``length``, which leaves the ranges."""
        at = bisect.bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        found = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.gaps[at]
        return gap, *found


def matched(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces of each length go, and the number of windows.

    ``counts``: how many pieces of each length.  A step (length, rank, n, window, each, offset) says: the ``n`` pieces from number ``rank`` on go, ``each`` of
    them a window one behind another from ``offset`` on, into the windows from ``window`` on.
    """
    left = {x: n for x, n in counts.items() if n}
    used, steps, gaps, windows = dict.fromkeys(left, 0), [], Gaps(capacity), 0
    large = sorted(x for x in left if 3 * x > capacity)

    def place(length: int, n: int, window: int, each: int, offset: int) -> None:
        steps.append((length, used[length], n, window, each, offset))
        used[length] += n
        left[length] -= n

    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        at = bisect.bisect_right(large, min(length, capacity - length)) - 1
        while at >= 0 and left[large[at]] < (2 if large[at] == length else 1):
            if not left[large[at]]:
                large.pop(at)
            at -= 1
        if at < 0:
            n = left[length]
            place(length, n, windows, 1, 0)
            gaps.add(capacity - length, windows, n)
        else:
            other = large[at]
            n = left[length] // 2 if other == length else min(left[length], left[other])
            place(length, n, windows, 1, 0)
            place(other, n, windows, 1, length)
            gaps.add(capacity - length - other, windows, n)
        windows += n
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            gap, first, n = gaps.take(length) or (capacity, windows, -(-left[length] // (capacity // length)))
            windows = max(windows, first + n)
            each = gap // length
            full = min(n, left[length] // each)
            place_at = capacity - gap
            if full:
                place(length, full * each, first, each, place_at)
                gaps.add(gap - each * length, first, full)
            rest = left[length] if full < n else 0
            if rest:  # fewer than one window takes
                place(length, rest, first + full, rest, place_at)
                gaps.add(gap - rest * length, first + full, 1)
                full += 1
            gaps.add(gap, first + full, n - full)
    return steps, windows


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth) of every piece; ``nth`` numbers the pieces of one length in one task."""
    if not 0 < capacity < LONGEST:
        raise ValueError(f"a window holds 1 to {LONGEST - 1} tokens")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    chosen = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    names = ["piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = library_encoder(spec.value).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            at: list[int] = []
            out: list[tuple] = []
            for i, content in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(content), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), task, int(seen[end - start])))
                    seen[end - start] += 1
                    at.append(i)
            columns = zip(*out, strict=True)
            kinds = [pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", *names])

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, piece int, " + ", ".join(f"{c} long" for c in names[1:]))


def best_fit(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece int, start, length, ids_crc32, sequence_id, offset) of every piece; sequence ids run from 0 without a gap."""
    pieces = staged(pieces_of(docs, tokenizer, end_id, capacity=capacity, key=key, text=text), "pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row a length, `capacity` at most
    steps, _ = matched({r["length"]: r["n"] for r in totals}, capacity)
    steps.sort()
    table = np.array(steps, np.int64).reshape(-1, 6)
    share = docs.sparkSession.sparkContext.broadcast(table)  # a few rows a length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, window, each, offset = share.value.T
        keys = (length << RANK_BITS) | rank
        for b in batches:
            own, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (own << RANK_BITS) | nth, "right") - 1
            behind = nth - rank[at]
            sequence, place = window[at] + behind // each[at], offset[at] + behind % each[at] * own
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(place)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["id"]
    return ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", key)
