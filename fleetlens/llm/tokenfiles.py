"""Token ids in Arrow files of equal-length sequences with masks, for random access without copies.

A part file holds record batches of fixed-size lists: ``ids`` (``length`` unsigned integers, 16 bits wide where the vocabulary
allows) and ``mask`` (false for padding, only at the end of a part). Beside it an index file has each document's start and
size in the part. Parts follow each other in ascending ``doc_id``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrowio import slices
from .subwords import word_vocabulary

LENGTH = 2048
"""Ids of a sequence."""

BATCH_SEQUENCES = 64
"""Sequences of a record batch: the unit of random access."""

PART_BYTES = 32 * 1024 * 1024
"""Text that a part should hold."""

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(width: int, length: int) -> pa.Schema:
    ids = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class PartWriter:
    """Writes one part: documents are added in order, full batches of sequences go out at once."""

    def __init__(self, place: fs.FileSystem, path: str, dtype: np.dtype, length: int):
        self.dtype, self.length, self.size = dtype, length, BATCH_SEQUENCES * length
        self.schema = sequence_schema(dtype.itemsize, length)
        self.sinks = [place.open_output_stream(f"{path}.arrow"), place.open_output_stream(f"{path}.index.arrow")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], INDEX)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.docs = 0

    def add(self, docs: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.waiting += ids
        self.held += int(sizes.sum())
        self.tokens += int(sizes.sum())
        self.docs += len(docs)
        if self.held >= self.size:
            flat = np.concatenate(self.waiting)
            whole = self.held // self.size * self.size
            for at in range(0, whole, self.size):
                self.write(flat[at:at + self.size], self.size)
            self.waiting, self.held = [flat[whole:].copy()], self.held - whole

    def write(self, flat: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(flat)) < used)
        self.ids.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)],
            schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.zeros(-(-self.held // self.length) * self.length, self.dtype)
            flat[:self.held] = np.concatenate(self.waiting)
            self.write(flat, self.held)
        for writer in (self.ids, self.index, *self.sinks):
            writer.close()


class PartReader:
    """Random access to the ids of one part; a slice inside one batch is not copied."""

    def __init__(self, place: fs.FileSystem, path: str, length: int = LENGTH):
        self.file = pa.ipc.open_file(self.opened(place, f"{path}.arrow"))
        self.docs = pa.ipc.open_file(self.opened(place, f"{path}.index.arrow"))
        self.size, self.last = BATCH_SEQUENCES * length, (-1, None)

    @staticmethod
    def opened(place: fs.FileSystem, path: str):
        return pa.memory_map(path) if isinstance(place, fs.LocalFileSystem) else place.open_input_file(path)

    def batch(self, number: int) -> np.ndarray:
        if self.last[0] != number:
            self.last = (number, self.file.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on, counted from the part's beginning."""
        pieces = []
        while count:
            number, offset = divmod(start, self.size)
            piece = self.batch(number)[offset:offset + count]
            pieces.append(piece)
            start, count = start + len(piece), count - len(piece)
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Write all texts' ids in ascending ``doc_id`` order and return the manifest: part, file, docs, tokens and base.

    A document is its text's ids and then ``end_id``; a null text is empty and has the end id alone. Rows of equal
    ``doc_id`` follow each other by text, null ids come first, other columns are not read, and an empty table gives no
    part. Each attempt of a task writes files of its own name below the shared folder and the manifest, which is pinned
    there too, names those of the attempt that counted.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_vocabulary(vocabulary)
        end = np.array([end_id], words.type)
        part, name, writer = TaskContext.get().partitionId(), "", None
        for piece in slices(batches, "text"):
            if writer is None:
                place, path = fs.FileSystem.from_uri(folder)
                place.create_dir(path, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                writer = PartWriter(place, f"{path}/{name}", words.type, length)
            ids = words.encode(piece.column("text"))
            writer.add(piece.column("doc_id").to_pylist(), [np.concatenate([np.frombuffer(x.as_buffer(), words.type), end]) for x in ids])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{name}"], "docs": [writer.docs], "tokens": [writer.tokens]})

    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part bigint, file string, docs bigint, tokens bigint").checkpoint()
    # One row per file: the running sum sees no documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document in the files: its start among all ids, number of ids and the ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, path = fs.FileSystem.from_uri(row["file"])
                reader = PartReader(place, path, length)
                for number in range(reader.docs.num_record_batches):
                    part = reader.docs.get_batch(number)
                    for at in range(0, part.num_rows, 256):
                        index = part.slice(at, 256)
                        starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                        ids = [reader.tokens(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts, sizes)]
                        yield pa.RecordBatch.from_arrays(
                            [index.column("doc_id"), pa.array(starts + row["base"]), index.column("n_tokens"), pa.array(ids, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"])

    files = manifest.select("file", "base")
    return files.repartition(F.col("file")).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
