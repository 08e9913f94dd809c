"""Fill-in-middle transformation with summaries of content-defined chunks.

A text's bytes are cut where a rolling hash says so, so that shared passages give shared chunks wherever they stand. A chunk's
summary says what matters to its neighbours: its words, its code points, and whether its first and last bytes belong to a word.
Summaries are kept by the chunk's own bytes, so a chunk that comes again is not looked at again, and two summaries combine into
that of the joined text. From the running sums of words, the chunk that holds a cut is found, and only that chunk is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowio import slices, texts
from .shingles import mixed

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

MASK = np.uint32(((1 << 11) - 1) << 16)
"""Bits of the rolling hash that are zero at a cut: once in 2,048 bytes."""

LEAST, MOST = 256, 16 * 1024
"""Bytes of a chunk."""

WINDOW = 32

MEMO_BYTES = 32 * 1024 * 1024
"""Chunks whose summaries a task keeps at a time."""

SLICE = 4 * 1024 * 1024

GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

BLANK = b" \t\n\x0b\x0c\r"


class Summary(NamedTuple):
    """What a piece of text tells its neighbours."""

    words: int
    points: int
    opens: bool
    """Whether its first byte belongs to a word."""
    ends: bool
    """Whether its last byte does."""


def summary(chunk: bytes) -> Summary:
    points = len(chunk) - int(np.count_nonzero(np.frombuffer(chunk, np.uint8) & 0xC0 == 0x80))
    return Summary(len(chunk.split()), points, chunk[0] not in BLANK, chunk[-1] not in BLANK)


class Memo:
    """Summaries by the chunk's bytes; the oldest half goes when there are too many bytes."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.held, self.known = limit, 0, {}

    def __call__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            found = self.known[chunk] = summary(chunk)
            self.held += len(chunk)
            if self.held > self.limit:
                for old in list(self.known)[:len(self.known) // 2 + 1]:
                    del self.known[old]
                self.held = sum(map(len, self.known))
        return found


def rolling(data: np.ndarray) -> np.ndarray:
    """At every byte the hash of the ``WINDOW`` bytes that end there, by doubling."""
    found = GEAR[data]
    width = 1
    while width < WINDOW:
        found[width:] += found[:-width] << np.uint32(width)
        width *= 2
    return found


def chunk_ends(cuts: np.ndarray, first: int, last: int) -> list[int]:
    """Where the chunks of the text between two places end, given the places after which the hash wants a cut."""
    ends, at = [], first
    for cut in cuts[np.searchsorted(cuts, first + LEAST):np.searchsorted(cuts, last)].tolist():
        if cut - at >= LEAST:
            while cut - at > MOST:
                at += MOST
                ends.append(at)
            if cut > at:
                ends.append(cut)
                at = cut
    while last - at > MOST:
        at += MOST
        ends.append(at)
    if last > at:
        ends.append(last)
    return ends


class Chunked:
    """A text as its chunks' running sums: words begun before each chunk, and code points."""

    def __init__(self, raw: bytes, ends: list[int], memo: Memo):
        self.raw, self.starts = raw, [0, *ends[:-1]]
        self.words, self.points, self.inside = [0], [0], [False]
        for low, high in zip(self.starts, ends):
            found = memo(raw[low:high])
            # A word that goes on from the chunk before began there.
            self.words.append(self.words[-1] + found.words - (self.inside[-1] and found.opens))
            self.points.append(self.points[-1] + found.points)
            self.inside.append(found.ends)
        self.ends = ends

    @property
    def units(self) -> int:
        """Words, each with the blanks before it, and one more for blanks at the end."""
        return self.words[-1] + (bool(self.raw) and not self.inside[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units == 0:
            return 0, 0
        if units >= self.units:
            return len(self.raw), self.points[-1]
        # The word's end lies before the first byte of the next word's blanks: in the chunk where the next word begins, or before.
        chunk = int(np.searchsorted(self.words, units, side="left")) - 1
        low, left = self.starts[chunk], units - self.words[chunk]
        begins = self._word_starts(chunk)[left - 1]
        at = low + begins
        while True:
            at = self._blank_after(at, self.ends[chunk])
            if at < self.ends[chunk] or chunk == len(self.ends) - 1:
                break
            chunk += 1
        inner = np.frombuffer(self.raw[self.starts[chunk]:at], np.uint8)
        return at, self.points[chunk] + len(inner) - int(np.count_nonzero(inner & 0xC0 == 0x80))

    def _word_starts(self, chunk: int) -> np.ndarray:
        """Where words begin in a chunk; one that goes on from the chunk before does not begin here."""
        inner = np.frombuffer(self.raw[self.starts[chunk]:self.ends[chunk]], np.uint8)
        word = ~((inner == 32) | ((inner >= 9) & (inner <= 13)))
        before = np.concatenate([[self.inside[chunk]], word[:-1]])
        return np.flatnonzero(word & ~before)

    def _blank_after(self, at: int, end: int) -> int:
        """The first blank from ``at`` on, or ``end``."""
        inner = np.frombuffer(self.raw[at:end], np.uint8)
        blank = (inner == 32) | ((inner >= 9) & (inner <= 13))
        return at + int(blank.argmax()) if blank.any() else end


def shares(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 that the id decides; a null id counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at:at + 8], 16) for at in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row: ``doc_id``, ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    A unit is a word with the blanks before it; blanks at the end are one more. The id and the seed alone decide the form and
    both cuts, so equal ids are cut alike and other orders of rows change nothing. Plain are empty and null texts, texts that
    hold one of the three marks, and the share of texts that ``fim_percent`` leaves; their two counts are null. A null
    ``doc_id`` stays null and counts as an empty id; repeated rows give a row each; other columns are not read; an empty table
    gives no row.
    """
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for part in slices(batches, "text", SLICE):
            column = texts(part.column("text"))
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].tolist()
            raw = memoryview(column.buffers()[2] or b"")
            data = np.frombuffer(raw[bounds[0]:bounds[-1]], np.uint8)
            cuts = np.flatnonzero(rolling(data) & MASK == 0) + 1 if len(data) else np.zeros(0, np.int64)
            rows = [[] for _ in range(5)]
            for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
                first, last = bounds[row] - bounds[0], bounds[row + 1] - bounds[0]
                text = data[first:last].tobytes()
                found = Chunked(text, [e - first for e in chunk_ends(cuts, first, last)], memo)
                for values, value in zip(rows, transformed(found, shares(doc_id, seed), fim_percent, spm_percent)):
                    values.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows, kinds))],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(made, schema)


def transformed(text: Chunked, draws: list[int], fim_percent: int, spm_percent: int) -> tuple:
    """Units, form, the two counts and the output of one text."""
    n, raw = text.units, text.raw
    if not raw or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= fim_percent:
        return n, "plain", None, None, raw
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, a_points), (b, b_points) = text.cut(low), text.cut(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if draws[3] % 100 < spm_percent else "psm"
    pieces = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    return n, form, a_points, b_points - a_points, b"".join(mark.encode() + pieces[mark] for mark in order)


def restored(form: Column, output: Column) -> Column:
    """The text from an output and its form: the three pieces stand between marks that no such text holds."""
    def between(mark: str, following: str) -> Column:
        low = F.position(F.lit(mark), output) + len(mark)
        return F.substr(output, low, F.position(F.lit(following), output) - low)

    rest = F.substr(output, F.position(F.lit(MIDDLE), output) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
