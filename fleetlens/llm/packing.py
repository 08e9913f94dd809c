"""Packing of documents into token sequences of one size by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import slices
from .subwords import word_vocabulary

WINDOW = 2048
BLOCK_WINDOWS = 128
"""Windows that one differencing run fills; a task holds one such block of pieces."""

PIECE = 256
"""Longest piece of a document's rest: with enough pieces per window the sums differ by a few ids."""

FILL = 0.997
"""Share of the block's room that is given pieces before the run."""

SLICE = 1024 * 1024
"""Text that a task encodes in one piece."""

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, so that the windows' sums are nearly equal.

    A partial partition has one sum per window, largest first. The two with the largest imbalance (largest minus smallest
    sum) are merged with opposite orders, until one is left.
    """
    heap, made = [], []
    for item, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, item, sums))
        made.append(None)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        made.append((left, right, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(made) - 1, sums))
    out = np.zeros(len(sizes), np.int64)
    todo = [(heap[0][1], np.arange(windows))] if heap else []
    while todo:
        node, places = todo.pop()
        if made[node] is None:
            out[node] = places[0]
            continue
        left, right, order = made[node]
        before = np.empty(windows, np.int64)
        before[order] = places
        todo += [(left, before), (right, before[::-1])]
    return out


def fill_windows(sizes: list[int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows: the fewest tried from the sum upwards of which none is too full."""
    windows = max(1, -(-sum(sizes) // window))
    while True:
        chosen = differencing(sizes, windows)
        if not len(sizes) or np.bincount(chosen, sizes, windows).max() <= window:
            return chosen, windows
        windows += 1


class Packer:
    """Collects pieces, and lays out a block whenever one is full; sequence numbers start with the task's number."""

    def __init__(self, task: int, window: int):
        self.window, self.next, self.room = window, task << 40, int(BLOCK_WINDOWS * window * FILL)
        self.pieces: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.place([(doc, start, ids[start:start + self.window], total)])
            start += self.window
        while start < total:
            stop = min(total, start + PIECE, start + self.room - self.held)
            self.pieces.append((doc, start, ids[start:stop], total))
            self.held += stop - start
            start = stop
            if self.held == self.room:
                self.flush()

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def flush(self) -> None:
        chosen, windows = fill_windows([len(p[2]) for p in self.pieces], self.window)
        filled: list[list] = [[] for _ in range(windows)]
        for piece, window in zip(self.pieces, chosen):
            filled[window].append(piece)
        for pieces in filled:
            if pieces:
                self.place(pieces)
        self.pieces, self.held = [], 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 7
        self.rows = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: its document, place in the document, ids (unsigned 32-bit, little-endian), sequence and offset there.

    A document is its text's ids and then ``end_id``. Stretches of a whole window are sequences of their own; the rest is cut
    into pieces of up to ``PIECE`` ids, and blocks of pieces are packed by differencing inside the task that encoded them, so
    nothing is shuffled and no group of documents meets in one task. A null text is empty and has the end id alone; repeated
    rows are packed each; a null ``doc_id`` stays null; other columns are not read; an empty table gives no row.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_vocabulary(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), window)
        end = np.array([end_id], words.type)
        for part in slices(batches, "text", SLICE):
            for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text"))):
                packer.add(doc, np.concatenate([np.frombuffer(ids.as_buffer(), words.type), end]))
            yield packer.taken()
        if packer.pieces:
            packer.flush()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)
