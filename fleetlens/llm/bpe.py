"""Byte-pair encoding and decoding through one table of distinct words.

Texts are split where they are read, into blocks of bounded size: a block holds its distinct words once and the places of its
texts' words as small numbers, both compressed. Each distinct word of all blocks is encoded once and its ids are joined
back to the blocks, which decode them by a join with the id-to-piece table and put ids and pieces in the words' places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import slices, texts
from .subwords import parts, word_vocabulary

BLOCK_BYTES = 24 * 1024 * 1024
"""Text of a block; one task holds one block and its words. A longer single text is a block of its own."""

RESULT_ROWS = 512

BUNDLE_BYTES = 32 * 1024 * 1024
"""Encoded words that a task holds before it sends them to their blocks."""


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words begin among all words (and where the last ends), and the words."""
    words = pc.ascii_split_whitespace(texts(column))
    return words.offsets.to_numpy(), words.flatten().dictionary_encode()


def block_parts(words: list[str]) -> tuple[list[list[str]], list[str]]:
    """The parts of each word of a block, and all distinct parts in order: sorted, they take less room in a shuffle."""
    lists = [parts(w) for w in words]
    return lists, sorted({p for found in lists for p in found})


class Block:
    """The texts of one block as places in the list of its distinct words."""

    KIND = "block bigint, doc_ids array<bigint>, sizes array<int>, words binary, places binary"

    def __init__(self):
        self.number: dict[str, int] = {}
        self.doc_ids: list = []
        self.sizes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_ids: pa.Array, column: pa.Array) -> None:
        offsets, words = words_of(column)
        number = self.number
        table = np.array([number.setdefault(w, len(number)) if w else -1 for w in words.dictionary.to_pylist()] or [0], np.int32)
        places = table[words.indices.to_numpy()]
        kept = np.concatenate([[0], np.cumsum(places >= 0)])[offsets - offsets[0]]
        self.doc_ids += doc_ids.to_pylist()
        self.sizes.append(np.diff(kept))
        self.places.append(places[places >= 0])
        self.held += column.nbytes

    def row(self, block: int) -> pa.RecordBatch:
        """The block's row: words by falling frequency, and their places as four bytes apart, both of which compress well."""
        places = np.concatenate(self.places)
        order = np.argsort(-np.bincount(places, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(order), "<i4")
        rank[order] = np.arange(len(order))
        names = list(self.number)
        places = rank[places]
        words = " ".join([names[i] for i in order]).encode()
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())),
             pa.array([np.concatenate(self.sizes).astype(np.int32)], pa.list_(pa.int32())),
             pa.array([zstandard.compress(words)], pa.binary()), pa.array([packed_numbers(places)], pa.binary())],
            ["block", "doc_ids", "sizes", "words", "places"])


def block_list(packed: bytes) -> list[str]:
    words = zstandard.decompress(packed).decode()
    return words.split(" ") if words else []


def block_places(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def split_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the task's texts, numbered by task and order."""
    number, block = TaskContext.get().partitionId() << 32, Block()
    for part in slices(batches, "text", BLOCK_BYTES // 4):
        column = texts(part.column("text"))
        if block.held and block.held + column.nbytes > BLOCK_BYTES:
            yield block.row(number)
            number, block = number + 1, Block()
        block.add(part.column("doc_id"), column)
    if block.doc_ids:
        yield block.row(number)


def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct parts of each block's words; sorted, they take less room in the shuffle."""
    for batch in batches:
        for row in range(batch.num_rows):
            found = block_parts(block_list(batch.column("words")[row].as_py()))[1]
            for at in range(0, len(found), 50_000):
                some = found[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[row].as_py()] * len(some), pa.int64()), pa.array(some, pa.string()),
                     pa.array(np.arange(at, at + len(some)), pa.int32())], ["block", "word", "place"])


def packed_numbers(values: np.ndarray) -> bytes:
    """Four-byte numbers, byte by byte apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded words of each block together, in the order of their places: in the shuffle to their blocks they take a third of the room."""
    held: list[pa.RecordBatch] = []

    def bundled() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        rows = rows.take(np.lexsort((rows.column("place").to_numpy(), rows.column("block").to_numpy()))).combine_chunks()
        blocks, places = rows.column("block").to_numpy(), rows.column("place").to_numpy()
        sizes = pc.binary_length(rows.column("ids")).to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = b"".join(rows.column("ids").to_pylist())
        edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            columns = [packed_numbers(np.diff(places[low:high], prepend=0)), packed_numbers(sizes[low:high]), zstandard.compress(data[ends[low]:ends[high]])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([blocks[low]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["block", "places", "sizes", "ids"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) > BUNDLE_BYTES:
            yield from bundled()
    if held:
        yield from bundled()


def unbundled(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Places and ids of a block's encoded words."""
    places, sizes, data = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for row in rows.to_pylist():
        places.append(np.cumsum(block_places(row["places"]), dtype=np.int64))
        sizes.append(block_places(row["sizes"]).astype(np.int64))
        data.append(zstandard.decompress(row["ids"]))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return np.concatenate(places), pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])


def joined(lists: np.ndarray, values: pa.Array, present: np.ndarray) -> pa.Array:
    """The present values of each list, joined by a space."""
    kept = np.concatenate([[0], np.cumsum(present)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept[lists], pa.int32()), values.filter(pa.array(present))), " ")


def decoded_words(packed: pa.Array, width: int, pieces: pa.Table) -> dict[str, pa.Array]:
    """The ids of each word as text, and its pieces by a join of the ids with the id-to-piece table; one space between each."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(f"<u{width}").astype(np.int32)
    lists, ids = pa.array((offsets - offsets[0]) // width, pa.int32()), pa.array(data)
    found = pieces.column("piece").combine_chunks().take(pc.index_in(ids, value_set=pieces.column("id").combine_chunks()))
    return {"ids": pc.binary_join(pa.ListArray.from_arrays(lists, ids.cast(pa.string())), " "),
            "pieces": pc.binary_join(pa.ListArray.from_arrays(lists, found), " ")}


def put_back(blocks: pa.Table, table: pa.Table, width: int, pieces: pa.Table) -> pa.Table:
    """Ids and pieces of each text of a block from the block's encoded words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
    at_places, ids = unbundled(table)
    coded = decoded_words(ids, width, pieces) if len(ids) else {}
    out = []
    for block in blocks.to_pylist():
        lists, names = block_parts(block_list(block["words"]))
        row = np.full(len(names), -1)
        row[at_places] = np.arange(len(at_places))
        place = {name: int(at) for name, at in zip(names, row)}
        at = np.fromiter((place[p] for found in lists for p in found), np.int64)
        inner = np.concatenate([[0], np.cumsum([len(found) for found in lists], dtype=np.int64)])
        found, at = at >= 0, pa.array(np.maximum(at, 0), mask=at < 0)
        values = {name: joined(inner, coded[name].take(at) if coded else pa.nulls(len(at), pa.string()), found) for name in ("ids", "pieces")}
        seen = pc.not_equal(values["ids"], "").to_numpy(zero_copy_only=False)
        places, ends = block_places(block["places"]), np.concatenate([[0], np.cumsum(block["sizes"])])
        for start in range(0, len(block["doc_ids"]), RESULT_ROWS):
            some = slice(start, start + RESULT_ROWS)
            bounds = ends[start:start + RESULT_ROWS + 1]
            mine = places[bounds[0]:bounds[-1]]
            ids, decoded = (joined(bounds - bounds[0], values[name].take(pa.array(mine)), seen[mine]) for name in ("ids", "pieces"))
            count = pc.add(pc.count_substring(ids, " "), pc.not_equal(ids, "").cast(pa.int32())).cast(pa.int64())
            out.append(pa.RecordBatch.from_arrays([pa.array(block["doc_ids"][some], pa.int64()), count, ids, decoded], schema=schema))
    return pa.Table.from_batches(out, schema=schema)


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """``word`` and its ``ids`` as bytes."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = word_vocabulary(vocabulary)
        for batch in batches:
            ids = [np.array(library.part_ids(w), library.type).tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], ["word", "ids"])

    return words.mapInArrow(encoded, "word string, ids binary")


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids`` (decimal, one space between) and ``decoded``, as the library gives them.

    A null text is empty and has no ids; repeated rows are encoded each; a null ``doc_id`` stays null; other columns are not
    read; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    library = word_vocabulary(vocabulary)
    numbers, names = zip(*library.pieces())
    # The id-to-piece table has the vocabulary's size, whatever the corpus.
    pieces = docs.sparkSession.sparkContext.broadcast(pa.table({"id": pa.array(numbers, pa.int32()), "piece": pa.array(names, pa.string())}))
    width = library.type.itemsize
    # Both uses of the blocks, and both of the words with the same columns, read the same shuffle.
    blocks = rows.mapInArrow(split_texts, Block.KIND).filter("block IS NOT NULL").repartition("block")
    used = blocks.mapInArrow(block_words, "block bigint, word string, place int").filter("word IS NOT NULL").repartition("word")
    table = encode_words(used.groupBy("word").agg(F.count("block").alias("blocks"), F.count("place").alias("places")), vocabulary)
    encoded = used.join(table, "word").select("block", "place", "ids").mapInArrow(bundles, "block bigint, places binary, sizes binary, ids binary")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(
        lambda left, right: put_back(left, right, width, pieces.value), "doc_id bigint, n_tokens bigint, ids string, decoded string")
