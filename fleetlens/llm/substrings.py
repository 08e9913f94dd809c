"""Removal of repeated passages of words: seeds at winnowed anchors, extended both ways.

A window of ``LENGTH`` words has its anchor at the run of ``GRAM`` words with the least hash inside it, the leftmost of equal
ones, so equal windows have equal anchors at the same place. A seed is an anchor with all windows that it anchors: neighbours
in the text, one segment. Documents meet by their seeds, and from the seed a match grows to both sides: where two segments are
equal as a whole, all their windows repeat; else a window repeats if some other segment of that seed reaches as far to the left
and to the right of it. Reaches are compared by the hashes of what they cover, so a seed's segments are counted, not paired.
Windows that repeat, joined, are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrowio import slices, texts
from .shingles import mixed

LENGTH = 35
"""Words of a window."""

GRAM = 12
"""Words of an anchor."""

SLICE = 4 * 1024 * 1024
"""Text that a task looks at in one piece."""

BASE = 0x9E3779B97F4A7C15 | 1


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin among all words (and where the last ends), and the words."""
    split = pc.ascii_split_whitespace(texts(column))
    words = split.flatten()
    full = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = split.offsets.to_numpy()
    return kept[offsets - offsets[0]], words.filter(full)


class Passages:
    """The words of some texts as running sums, from which any stretch's hash is read."""

    def __init__(self, column: pa.Array):
        self.offsets, words = split_words(column)
        coded = words.dictionary_encode()
        table = np.array([xxhash.xxh3_64_intdigest(w.as_buffer() or b"") for w in coded.dictionary] or [0], np.uint64)
        values = table[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        up, down = np.full(len(values) + 1, BASE, np.uint64), np.full(len(values) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(up)[:-1], dtype=np.uint64)])

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the words from ``low`` to before ``high``."""
        return mixed((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment the text's row, first window, number of windows, and anchor, as places among all words."""
        empty = np.zeros(0, np.int64)
        total = len(self.sums) - 1
        if total < LENGTH:
            return empty, empty, empty, empty
        places = np.arange(total - GRAM + 1)
        grams = self.hashes(places, places + GRAM)
        anchors = sliding_least_place(grams, LENGTH - GRAM + 1)
        starts = np.arange(len(anchors))
        row = np.searchsorted(self.offsets, starts, side="right") - 1
        inside = starts + LENGTH <= self.offsets[row + 1]
        starts, anchors, row = starts[inside], anchors[inside], row[inside]
        if not len(starts):
            return empty, empty, empty, empty
        new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
        at = np.flatnonzero(new)
        return row[at], starts[at], np.diff(np.concatenate([at, [len(starts)]])), anchors[at]


def sliding_least_place(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` neighbouring values, the leftmost of equal ones."""
    best = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def seed_rows(docs: DataFrame, places: bool) -> DataFrame:
    """``seed`` and ``content`` hash of every segment; with ``places`` also the text's ``mark``, the first window, their number, and the anchor.

    Windows and anchors count from the text's first word.
    """
    kind = "seed bigint, content bigint" + (", mark bigint, first bigint, windows bigint, anchor bigint" if places else "")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            passages = Passages(part.column("text"))
            row, first, count, anchor = passages.segments()
            columns = {"seed": _numbers(passages.hashes(anchor, anchor + GRAM)),
                       "content": _numbers(passages.hashes(first, first + count - 1 + LENGTH))}
            if places:
                columns |= {"mark": part.column("mark").take(pa.array(row, pa.int64())), "first": pa.array(first - passages.offsets[row], pa.int64()),
                            "windows": pa.array(count, pa.int64()), "anchor": pa.array(anchor - passages.offsets[row], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("mark", "text").mapInArrow(found, kind)


def reach_rows(docs: DataFrame) -> DataFrame:
    """``reach``, ``mark`` and ``window`` of every window of the segments that a text comes with.

    A reach is a seed with the words before and after it that a window has.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            passages = Passages(part.column("text"))
            wanted = part.column("segments")
            owner = np.repeat(np.arange(len(wanted)), pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False))
            chosen = wanted.flatten()
            first, count = chosen.field("first").to_numpy(), chosen.field("windows").to_numpy()
            anchor = np.repeat(passages.offsets[owner] + chosen.field("anchor").to_numpy(), count)
            start = np.repeat(passages.offsets[owner] + first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            left, right = passages.hashes(start, anchor), passages.hashes(anchor + GRAM, start + LENGTH)
            reach = mixed(mixed(mixed(left) + passages.hashes(anchor, anchor + GRAM)) + right)
            yield pa.RecordBatch.from_arrays(
                [_numbers(reach), part.column("mark").take(pa.array(np.repeat(owner, count), pa.int64())),
                 pa.array(start - np.repeat(passages.offsets[owner], count), pa.int64())], ["reach", "mark", "window"])

    return docs.select("mark", "text", "segments").mapInArrow(found, "reach bigint, mark bigint, window bigint")


def without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's number of words, its removed spans as maximal runs of words, and the words that stay, one space between."""
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    for part in slices(batches, "text", SLICE):
        offsets, words = split_words(part.column("text"))
        runs = part.column("runs")
        owner = np.repeat(np.arange(len(runs)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
        found = runs.flatten()
        # A text's last place stands alone between it and the next text, so no run goes over.
        gone = np.zeros(len(words) + len(runs) + 1, np.int64)
        np.add.at(gone, offsets[owner] + owner + found.field("low").to_numpy(), 1)
        np.add.at(gone, offsets[owner] + owner + found.field("high").to_numpy(), -1)
        out = np.cumsum(gone) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
        low, high = edges[::2], edges[1::2]
        begins = offsets[:-1] + np.arange(len(runs))
        row = np.searchsorted(begins, low, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(low - begins[row], pa.int64()), pa.array(high - begins[row], pa.int64())], ["low", "high"])
        stays = ~np.delete(out, np.append(offsets[1:] + np.arange(len(runs)), len(out) - 1))
        kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays))), " ")
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("carried"), pa.array(np.diff(offsets), pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(runs) + 1)), pa.int32()), spans).cast(kind), joined],
            ["doc_id", "carried", "n_words", "spans", "kept"])


def remove_passages(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row: ``doc_id``, ``n_words``, the removed ``spans`` (maximal runs of words ``low`` to ``high``) and the ``kept`` text.

    Words are runs of bytes other than ASCII white space, and kept as they are; kept words are joined by one space. Removed is
    every word covered by ``LENGTH`` words that also start at another place of any text, its own included. Equal texts, repeated
    rows among them, remove each other wholly if long enough. A null text has no words; a null ``doc_id`` stays null; shorter texts stay
    whole; the columns of ``carry`` come along as the fields of ``carried`` and other columns are not read; an empty table gives
    no row. Texts and passages are told apart by 64-bit hashes.
    """
    shared_dir(docs.sparkSession)
    carried = F.struct(F.lit(0).alias("none"), *carry).alias("carried")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), carried)
    docs = docs.withColumn("mark", F.xxhash64("text"))
    # Counts shrink on the map side. They are written before they are joined, so that adaptive execution can split what a hot
    # key brings from the other side.
    seeds = seed_rows(docs, False).groupBy("seed").agg(
        F.count(F.lit(1)).alias("held"), (F.min("content") != F.max("content")).alias("differ")).filter("held > 1").select("seed", "differ").checkpoint()
    met = seed_rows(docs, True).join(seeds, "seed").checkpoint()
    contents = met.groupBy("content").agg(
        F.count(F.lit(1)).alias("copies"), F.max("differ").alias("differ"), F.min(F.struct("mark", "first", "windows", "anchor")).alias("one")).checkpoint()
    whole = met.join(contents.filter("copies > 1").select("content"), "content", "left_semi").select(
        "mark", F.col("first").alias("low"), (F.col("first") + F.col("windows") + (LENGTH - 1)).alias("high")).distinct()
    ids = docs.groupBy("mark").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("first_id"))
    lists = contents.filter("differ").select("one.*").groupBy("mark").agg(
        F.collect_list(F.struct("first", "windows", "anchor")).alias("segments")).join(ids, "mark").checkpoint()
    # Of equal texts one is looked at; of repeated rows each, which changes no answer.
    chosen = docs.join(lists, "mark").filter(F.coalesce("doc_id", F.lit(0)) - F.col("first_id") == 0)
    reached = reach_rows(chosen.select("doc_id", "carried", "mark", "text", "segments")).checkpoint()
    place = F.struct("mark", "window")
    several = reached.groupBy("reach").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("reach").checkpoint()
    grown = reached.join(several, "reach", "left_semi").select("mark", F.col("window").alias("low"), (F.col("window") + LENGTH).alias("high"))
    runs = whole.unionByName(grown.distinct()).groupBy("mark").agg(F.collect_list(F.struct("low", "high")).alias("runs")).checkpoint()
    schema = f"doc_id bigint, carried {docs.schema['carried'].dataType.simpleString()}, n_words bigint, spans array<struct<low:bigint,high:bigint>>, kept string"
    return docs.join(runs, "mark", "left").select("doc_id", "carried", "text", "runs").mapInArrow(without_runs, schema)
