"""Packing of documents into training windows by Karmarkar-Karp multiway differencing.

A document's tokens, with the end token behind them, are cut into full windows, which need no partner, and a rest.  Rests are gathered
in groups of bounded size; each rest is further cut into pieces of at most ``piece`` tokens.  A
group starts with the fewest windows that could hold it.  Every piece begins as a partial partition, itself in one window and all others
empty; the two partial partitions with the largest imbalance (heaviest less lightest window) are merged again
and again, heaviest windows of one with the lightest of the other, until one partition is left.  If its heaviest window exceeds the
capacity, the window count rises and the group is partitioned anew.  Windows of a group come out near-equal.

Each task packs the rows of its own partition: no shuffle, and memory for one group of rests besides the slice of texts
in hand.  ``sequence_id`` holds the partition in its upper bits, so ids of different tasks never meet.

Results for odd input: a null or empty text is the end token alone; repeated rows are packed like
any others; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewire.llm.bpe import library_encoder, read_spec
from tidewire.llm.shared import slices, text_of

GROUP = 1024
PIECE = 512


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and the sum of each of ``k`` windows."""
    n = len(lengths)
    nodes: list[tuple] = [()] * n
    order = np.argsort(-lengths, kind="stable")
    heap = []
    for i in order:
        sums = np.zeros(k, np.int64)
        sums[0] = lengths[i]
        heap.append((-int(lengths[i]) if k > 1 else 0, int(i), sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heap[0]
        sums = left + right[::-1]
        by_size = np.argsort(-sums, kind="stable")
        sums = sums[by_size]
        nodes.append((a, b, by_size))
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), len(nodes) - 1, sums))
    _, root, sums = heap[0]
    window = np.zeros(n, np.int64)
    stack = [(root, np.arange(k))]  # of each node, the final window of each of its windows
    while stack:
        node, at = stack.pop()
        if node < n:
            window[node] = at[0]
            continue
        a, b, by_size = nodes[node]
        own = np.empty(k, np.int64)
        own[by_size] = at
        stack += [(a, own), (b, own[::-1])]
    return window, sums


def windows_for(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece, with no window above the capacity, and the number of windows."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window, sums = differencing(lengths, k)
        if sums[0] <= capacity:
            return window, k
        k += max(1, k * int(sums[0] - capacity) // (4 * capacity))


class Packer:
    """Pieces of one task, packed group by group."""

    def __init__(self, capacity: int, group: int, piece: int) -> None:
        self.capacity, self.group, self.piece = capacity, group, min(piece, capacity)
        self.rests: list[tuple] = []
        self.out: list[tuple] = []
        self.sequence = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

    def _emit(self, doc, start: int, ids: bytes, total: int, sequence: int, offset: int) -> None:
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        """A document's packed ids, end token included."""
        total, full = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._emit(doc, start, ids[4 * start : 4 * (start + self.capacity)], total, self.sequence, 0)
            self.sequence += 1
        for start in range(full, total, self.piece):
            self.rests.append((doc, start, ids[4 * start : 4 * min(start + self.piece, total)], total))
        if len(self.rests) >= self.group:
            self.flush()

    def flush(self) -> None:
        if not self.rests:
            return
        lengths = np.array([len(r[2]) // 4 for r in self.rests])
        window, k = windows_for(lengths, self.capacity)
        filled = [0] * k
        for (doc, start, ids, total), w, size in zip(self.rests, window.tolist(), lengths.tolist(), strict=True):
            self._emit(doc, start, ids, total, self.sequence + w, filled[w])
            filled[w] += size
        self.sequence += k
        self.rests = []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 2048, group: int = GROUP, piece: int = PIECE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    chosen = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    kind = dict(chosen.dtypes)["id"]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = library_encoder(spec.value).ids, Packer(capacity, group, piece), end_id

        def ready() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type[0]), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        for b in slices(batches):
            id_type[:] = [b.column(0).type]
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, np.array([*encode(content), end], "<u4").tobytes())
            if packer.out:
                yield ready()
        packer.flush()
        if packer.out:
            yield ready()

    return chosen.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:])).withColumnRenamed("id", key)
