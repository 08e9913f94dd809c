"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A string of ``LENGTH`` bytes is found through its anchor, the gram of ``GRAM`` bytes with the least hash inside it, so equal
strings have equal anchors at the same place. Grams held by one place only are left out by a count. What is left are segments:
stretches of neighbouring strings with the same anchor. Segments with equal anchors meet in one task, which takes them in
batches: a batch gets the sorted array of its suffixes, is merge-scanned against every level there is for common beginnings of
``LENGTH`` bytes, and then joins the levels, where two of equal size merge into one of the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrowio import released, slices, texts
from .shingles import mixed

LENGTH = 200
"""Bytes of a string whose repetition counts."""

GRAM = 64
"""Bytes of an anchor."""

HOT = 1000
"""Texts from which on a gram's segments are dealt by more of their content than the gram."""

CUT = 16
"""Neighbouring strings of a hot segment that stay together."""

MORE_TASKS = 8

SLICE = 512 * 1024
"""Text that a task looks at in one piece; its sums and hashes take some sixty times as much."""

PIECE = 64 * 1024
"""Bytes of a run of segments that go as one."""

BATCH_BYTES = 8 * 1024 * 1024
"""Bytes of segments that are sent on together."""

PLACE_BITS = 28
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    base, inverse = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every place, from sums over all bytes before it."""
    up, down = powers(SLICE + LENGTH)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[GRAM:] - sums[:-GRAM]) * down[:len(data) - GRAM + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values: blocks' running minima from both sides."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and where each begins and the last ends."""
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)])
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[_first(column):][:bounds[-1]], bounds


def segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The segments of the texts: text's row, first string, number of strings, anchor (places in the bytes), and gram.

    The bytes are looked at in pieces that overlap by a string; a segment that goes on behind a piece is two.
    """
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        yield _segments(data[at:at + SLICE + LENGTH - 1], at, bounds)


def _segments(data: np.ndarray, offset: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    empty = np.zeros(0, np.int64)
    hashes = gram_hashes(data)
    # The place in the low bits makes the leftmost of equal grams the least.
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1)
    anchors = (least & low).astype(np.int64)
    starts = np.arange(len(anchors)) + offset
    row = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + LENGTH <= bounds[row + 1]
    starts, anchors, row = starts[inside], anchors[inside], row[inside]
    if not len(starts):
        return empty, empty, empty, empty, empty
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    return row[at], starts[at], np.diff(np.concatenate([at, [len(starts)]])), anchors[at] + offset, hashes[anchors[at]].view(np.int64)


def _first(column: pa.Array) -> int:
    """Where the first text begins in the column's bytes."""
    return int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0


def first_of_each(row: np.ndarray, grams: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct pairs of row and gram, and whether each pair is there twice or one of its own is marked so."""
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])])) if len(row) else np.zeros(0, np.int64)
    if not len(new):
        return new, np.zeros(0, bool)
    return order[new], (np.diff(np.append(new, len(row))) > 1) | np.logical_or.reduceat(twice[order], new)


def gram_rows(docs: DataFrame) -> DataFrame:
    """``gram``, ``mark`` and whether the text has it at two anchors, once for each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            rows, all_grams, several = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for row, _, _, _, grams in segments(*text_bytes(texts(part.column("text")))):
                at, twice = first_of_each(row, grams, np.zeros(len(row), bool))
                rows.append(row[at])
                all_grams.append(grams[at])
                several.append(twice)
            row, grams = np.concatenate(rows), np.concatenate(all_grams)
            at, twice = first_of_each(row, grams, np.concatenate(several))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[at], pa.int64()), part.column("mark").take(pa.array(row[at], pa.int64())), pa.array(twice, pa.bool_())],
                ["gram", "mark", "twice"])

    return docs.select("mark", "text").mapInArrow(found, "gram bigint, mark bigint, twice boolean")


def runs_of(chosen: np.ndarray, start: np.ndarray, count: np.ndarray, gram: np.ndarray) -> list[tuple[int, int]]:
    """First and last (and one) of the chosen segments that follow each other without a gap and have one gram."""
    if not len(chosen):
        return []
    new = (chosen[1:] != chosen[:-1] + 1) | (gram[chosen[1:]] != gram[chosen[:-1]]) | (start[chosen[1:]] != start[chosen[:-1]] + count[chosen[:-1]])
    edges = np.flatnonzero(np.concatenate([[True], new, [True]]))
    return [(int(chosen[a]), int(chosen[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:])]


def period_of(data: np.ndarray, first: int, end: int, anchors: np.ndarray) -> int:
    """The period of the bytes of a run, from the distance of its anchors; 0 if there is none."""
    steps = np.diff(anchors)
    if not len(steps) or (steps != steps[0]).any():
        return 0
    period = int(steps[0])
    return period if np.array_equal(data[first + period:end], data[first:end - period]) else 0


def segment_rows(docs: DataFrame) -> DataFrame:
    """The segments of texts that come with the ``grams`` to look at: ``key`` to meet by, ``mark``, ``start``, ``bytes`` and ``high``.

    Neighbouring segments of one gram go as one run, so that texts which repeat themselves at short distances are not sent many times over; of
    a run with a period only the strings of one period go, and ``high`` says up to where all repeat. A segment of a hot gram
    is cut by the strings' distance to the anchor, and its key has what the strings of a cut share.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out_marks, starts, pieces, highs, held = [], [], [], [], [], 0

        def taken() -> pa.RecordBatch:
            columns = [pa.array(keys, pa.int64()), pa.array(out_marks, pa.int64()), pa.array(starts, pa.int64()), pa.array(pieces, pa.binary()), pa.array(highs, pa.int64())]
            for column in (keys, out_marks, starts, pieces, highs):
                column.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "mark", "start", "bytes", "high"])

        for part in slices(batches, "text", SLICE):
            data, bounds = text_bytes(texts(part.column("text")))
            wanted, hot = part.column("grams"), part.column("hot")
            marks, raw = part.column("mark").to_numpy(), memoryview(data)
            for row, start, count, anchor, gram in segments(data, bounds):
                edges = np.searchsorted(row, np.arange(len(marks) + 1))
                for text in np.flatnonzero(np.diff(edges)).tolist():
                    mine = slice(edges[text], edges[text + 1])
                    chosen = mine.start + np.flatnonzero(np.isin(gram[mine], wanted[text].values.to_numpy()))
                    very = set(hot[text].values.to_pylist())
                    for one, behind in runs_of(chosen, start, count, gram):
                        first, last = int(start[one]), int(start[behind - 1] + count[behind - 1])
                        period, high = period_of(data, first, last - 1 + LENGTH, anchor[one:behind]), None
                        if period and last - first > period:
                            high, last = last - 1 + LENGTH - int(bounds[text]), first + period
                        if int(gram[one]) in very:
                            cuts = [cut for at in range(one, behind) if start[at] < last
                                    for cut in hot_cuts(raw, int(start[at]), min(last, int(start[at] + count[at])), int(anchor[at]))]
                        else:
                            cuts = [(low, min(low + PIECE, last), int(gram[one])) for low in range(first, last, PIECE)]
                        for number, (low, stop, key) in enumerate(cuts):
                            keys.append(key)
                            out_marks.append(marks[text])
                            starts.append(low - bounds[text])
                            pieces.append(bytes(raw[low:stop - 1 + LENGTH]))
                            highs.append(high if number == 0 else None)
                            held += len(pieces[-1])
                            if held > BATCH_BYTES:
                                yield taken()
                                held = 0
        yield taken()

    return docs.mapInArrow(found, "key bigint, mark bigint, start bigint, bytes binary, high bigint")


def hot_cuts(raw: memoryview, first: int, last: int, place: int) -> Iterator[tuple[int, int, int]]:
    """First and last string, and key, of the cuts of a hot segment."""
    while first < last:
        group = (place - first) // CUT
        stop = min(last, place - group * CUT + 1)
        shared = raw[place - group * CUT:place - group * CUT - CUT + 1 + LENGTH]
        yield first, stop, xxhash.xxh3_64_intdigest(shared, seed=group) - (1 << 63)
        first = stop


class Level:
    """Suffixes in the order of their first ``LENGTH`` bytes: eight bytes from every place on, places, and suffix numbers."""

    def __init__(self, words: np.ndarray, places: np.ndarray, numbers: np.ndarray, batches: int):
        self.words, self.places, self.numbers, self.batches = words, places, numbers, batches


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number that sorts as they do."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for at in range(8):
        out = out << np.uint64(8) | padded[at:at + len(data)]
    return out


def sort_suffixes(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and the number of each one's class of equal first ``LENGTH`` bytes, in that order.

    Eight bytes are compared at a time, and only suffixes that are equal so far go on. Sorted runs merge in linear time.
    """
    key = words[places]
    order = np.argsort(key, kind="stable")
    key = key[order]
    breaks = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    for depth in range(8, LENGTH, 8):
        tied = ~breaks
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(breaks)[at]
        key = words[places[order[at]] + depth]
        again = np.lexsort((key, group))
        order[at] = order[at][again]
        key, group = key[again], group[again]
        breaks[at[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order, np.cumsum(breaks)


class SuffixFamily:
    """Levels of suffix arrays and which suffixes have been seen twice."""

    def __init__(self):
        self.levels: list[Level] = []
        self.repeated = np.zeros(1024, bool)
        self.count = 0

    def merged(self, a: Level, b: Level) -> Level:
        """Both levels as one; suffixes with a common beginning are noted on the way."""
        words = np.concatenate([a.words, b.words])
        places = np.concatenate([a.places, b.places + len(a.words)])
        numbers = np.concatenate([a.numbers, b.numbers])
        order, classes = sort_suffixes(words, places)
        numbers = numbers[order]
        self.note(numbers, classes)
        return Level(words, places[order], numbers, a.batches + b.batches)

    def note(self, numbers: np.ndarray, classes: np.ndarray) -> None:
        same = np.flatnonzero(classes[1:] == classes[:-1])
        self.repeated[numbers[same]] = True
        self.repeated[numbers[same + 1]] = True

    def scan(self, new: Level, old: Level) -> None:
        """Merge-scan: note the common beginnings of the new suffixes and those of a level that start alike."""
        first = new.words[new.places]
        theirs = old.words[old.places]
        near = np.flatnonzero(np.isin(theirs, first))
        if not len(near):
            return
        places = np.concatenate([new.places, old.places[near] + len(new.words)])
        order, classes = sort_suffixes(np.concatenate([new.words, old.words]), places)
        self.note(np.concatenate([new.numbers, old.numbers[near]])[order], classes)

    def add(self, pieces: list[bytes]) -> int:
        """Take a batch of segments and return the number of its first suffix; the others follow in order."""
        begin = self.count
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = sizes - LENGTH + 1
        total = int(counts.sum())
        while begin + total > len(self.repeated):
            self.repeated = np.concatenate([self.repeated, np.zeros(len(self.repeated), bool)])
        self.count += total
        offsets = np.cumsum(sizes) - sizes
        places = np.arange(total) + np.repeat(offsets - np.cumsum(counts) + counts, counts)
        words = eights(data)
        order, classes = sort_suffixes(words, places)
        new = Level(words, places[order], begin + order, 1)
        self.note(new.numbers, classes)
        for level in self.levels:
            if level.batches != 1:
                self.scan(new, level)
        while self.levels and self.levels[-1].batches == new.batches:
            new = self.merged(self.levels.pop(), new)
        self.levels.append(new)
        return begin


def repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mark``, ``low`` and ``high``: stretches of bytes covered by strings that start at two places, for one task's segments.

    A segment that was there before repeats as a whole and is not kept again.
    """
    family, known, whole, kept = SuffixFamily(), {}, set(), []
    marks, lows, highs = [], [], []

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (marks, lows, highs)], ["mark", "low", "high"])
        for column in (marks, lows, highs):
            column.clear()
        return out

    for batch in batches:
        fresh = []
        for mark, start, piece, high in zip(*(batch.column(c).to_pylist() for c in ("mark", "start", "bytes", "high"))):
            if high is not None:
                marks.append(mark)
                lows.append(start)
                highs.append(high)
            place = known.get(piece)
            if place is None:
                known[piece] = len(kept) + len(fresh)
                fresh.append((mark, start, piece))
            else:
                marks.append(mark)
                lows.append(start)
                highs.append(start + len(piece))
                whole.add(place)
        if fresh:
            begin = family.add([p for _, _, p in fresh])
            for mark, start, piece in fresh:
                kept.append((mark, start, len(piece), begin))
                begin += len(piece) - LENGTH + 1
        yield taken()
    for place, (mark, start, size, begin) in enumerate(kept):
        count = size - LENGTH + 1
        flags = np.ones(count, bool) if place in whole else family.repeated[begin:begin + count]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            marks.append(mark)
            lows.append(start + low)
            highs.append(start + high - 1 + LENGTH)
    yield taken()
    del family, known, whole, kept
    released()


def joined_runs(lows: np.ndarray, highs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of stretches that may overlap or touch."""
    if not len(lows):
        return []
    order = np.argsort(lows, kind="stable")
    lows, ends = lows[order], np.maximum.accumulate(highs[order])
    new = np.flatnonzero(np.concatenate([[True], lows[1:] > ends[:-1]]))
    return list(zip(lows[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist()))


def without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's removed spans, as maximal runs, and the bytes that stay."""
    for part in slices(batches, "text", SLICE):
        spans, kept = [], []
        for text, runs, copies in zip(texts(part.column("text")), part.column("runs"), part.column("copies").to_pylist()):
            raw = memoryview(text.as_buffer() or b"")
            found = []
            if copies > 1 and len(raw) >= LENGTH:
                found = [(0, len(raw))]
            elif runs.is_valid:
                found = joined_runs(runs.values.field("low").to_numpy(), runs.values.field("high").to_numpy())
            spans.append([{"low": low, "high": high} for low, high in found])
            edges = [0, *(edge for span in found for edge in span), len(raw)]
            kept.append(b"".join(raw[low:high] for low, high in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("carried"), pc.binary_length(texts(part.column("text"))).cast(pa.int64()),
             pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "carried", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row: ``doc_id``, ``n_bytes``, the removed ``spans`` (maximal runs ``low`` to ``high``) and the ``kept`` bytes.

    The columns of ``carry`` come along as the fields of ``carried``.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also starts at another place of any text, its own
    included. Equal texts, repeated rows among them, remove each other wholly if long enough. A null text is empty; a null
    ``doc_id`` stays null; shorter texts stay whole; other columns are not read; an empty table gives no row. Texts are told
    apart by 64-bit hashes; strings are compared byte by byte.
    """
    shared_dir(docs.sparkSession)
    carried = F.struct(F.lit(0).alias("none"), *carry).alias("carried")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), carried)
    docs = docs.withColumn("mark", F.xxhash64("text"))
    # The count and the join read the same shuffle, for which both must need the same columns.
    rows = gram_rows(docs).filter("gram IS NOT NULL").repartition("gram")
    several = rows.groupBy("gram").agg(
        F.min("mark").alias("a"), F.max("mark").alias("b"), F.max("twice").alias("inside"), F.count(F.lit(1)).alias("held")).filter(
        "a <> b OR inside").select("gram", (F.col("held") > HOT).alias("very"))
    grams = rows.join(several, "gram").groupBy("mark").agg(
        F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("very"), F.col("gram"))).alias("hot"),
        F.max("twice").alias("twice")).checkpoint()
    kinds = docs.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", F.lit(0))).alias("first_id"))
    # Of equal texts one is looked at. Both joins with the texts read the same shuffle.
    chosen = docs.join(grams.join(kinds, "mark"), "mark").filter(
        F.coalesce("doc_id", F.lit(0)) - F.col("first_id") == 0)  # not as a further key of the join
    # A task holds all its segments, so they get more tasks than a shuffle usually has.
    tasks = MORE_TASKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = segment_rows(chosen.select("doc_id", "carried", "mark", "text", "grams", "hot")).repartition(tasks, "key")
    runs = met.mapInArrow(repeated_runs, "mark bigint, low bigint, high bigint").groupBy("mark").agg(
        F.collect_list(F.struct("low", "high")).alias("runs"))
    known = docs.join(kinds.select("mark", "copies").join(runs, "mark", "left"), "mark").select("doc_id", "carried", "text", "runs", "copies")
    schema = f"doc_id bigint, carried {docs.schema['carried'].dataType.simpleString()}, n_bytes bigint, spans array<struct<low:bigint,high:bigint>>, kept binary"
    return known.mapInArrow(without_runs, schema)
