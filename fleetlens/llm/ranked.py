"""Ranked lexical search: accumulators for short lists, skipping over long ones.

Documents are taken in blocks where they are read. A block has an inverted list, ordered by document, for every term that some
query asks for. For a query the short lists of a block are summed term by term into accumulators, which from there on are one
more list with a known highest value. This list and the long lists are then walked document by document: the best results so
far set a score to reach, lists that together cannot reach it bring up no document of their own, and are only probed, highest
value first, for documents that the others brought up and that can still reach it. A task's best results go on from block to
block; only they leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrowio import slices, texts

BLOCK_BYTES = 8 * 1024 * 1024
"""Text of a block of documents; a longer single text is a block of its own."""

QUERY_BYTES = 4 * 1024 * 1024
"""Query text that a pass over the documents should take along: more queries are dealt to more passes."""

SHORT_SHARE = 16
"""A list is short if it holds at most a ``SHORT_SHARE``-th of the block's documents."""

STRIDE = 512
"""Documents that are brought up before the score to reach is looked at again."""

SALT = 64

TERM = np.full(256, ord(" "), np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM[_low:_high] = np.arange(_low, _high)
TERM[0x41:0x5B] += 32
"""What each byte of a text becomes: term bytes stay, A-Z go to lower case, all else is a space."""


def terms_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's terms begin among all terms (and where the last ends), and the terms."""
    column = texts(column)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = TERM[np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]]
    clean = pa.StringArray.from_buffers(len(column), pa.py_buffer((bounds - bounds[0]).astype(np.int32)), pa.py_buffer(data))
    split = pc.ascii_split_whitespace(clean)
    terms = split.flatten()
    full = pc.not_equal(terms, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = split.offsets.to_numpy()
    return kept[offsets - offsets[0]], terms.filter(full)


def query_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``query`` (a hash of its terms), ``block`` of no meaning but size, and the distinct ``terms``, once for equal rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1024 * 1024):
            offsets, terms = terms_of(part.column("text"))
            lists = [sorted(set(terms.slice(low, high - low).to_pylist())) for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(lists, pa.list_(pa.string()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(found, "item_id bigint, terms array<string>").withColumn("query", F.xxhash64("item_id", "terms"))


class Queries:
    """The queries of a pass: their terms as numbers."""

    def __init__(self, rows: list):
        self.keys = [r.query for r in rows]
        names: dict[str, int] = {}
        self.terms = [np.array([names.setdefault(t, len(names)) for t in r.terms], np.int64) for r in rows]
        self.names = pa.array(list(names), pa.string())

    def counted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text; and inverted lists: term, text and how often, by term and text."""
        offsets, terms = terms_of(column)
        coded = terms.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.names), -1).to_numpy() if len(coded.dictionary) else np.zeros(0, np.int64)
        number = known[coded.indices.to_numpy()].astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes)), sizes)
        asked = number >= 0
        held, often = np.unique(number[asked] * max(1, len(sizes)) + text[asked], return_counts=True)
        return sizes, held // max(1, len(sizes)), held % max(1, len(sizes)), often


def statistics(docs: DataFrame, queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and per asked term the documents that hold it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        held, full, total = np.zeros(len(asked.names), np.int64), 0, 0
        for part in slices(batches, "text", BLOCK_BYTES):
            sizes, term, _, _ = asked.counted(part.column("text"))
            held += np.bincount(term, minlength=len(held))
            full, total = full + int((sizes > 0).sum()), total + int(sizes.sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [full, total]))], ["term", "held"])

    # One row for each of the pass's terms: bounded like its queries.
    sums = docs.select("text").mapInArrow(found, "term bigint, held bigint").groupBy("term").agg(F.sum("held").alias("held"))
    rows = {r.term: r.held for r in sums.collect()}
    held = np.array([rows.get(t, 0) for t in range(len(queries.value.names))], np.int64)
    return rows.get(-1, 0), rows.get(-2, 0), held


def impacts(weight: np.ndarray, often: np.ndarray, length_part: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * often // (1000 * often + 20 * length_part))


def length_parts(sizes: np.ndarray, full: int, total: int) -> np.ndarray:
    """What a document's number of terms contributes to the denominator of its scores."""
    if sizes.size and 50 * int(sizes.max()) * full >= 1 << 63:
        return np.array([50 + 50 * int(n) * full // total for n in sizes], np.int64)
    return 50 + 50 * sizes.astype(np.int64) * full // max(1, total)


class Best:
    """The ``k`` best documents so far: highest score first, then the smaller id; without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """The score that a document has to reach to come in at all."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def take(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.missing, missing)
        order = np.lexsort((ids, missing, -scores))[:self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


class Lists:
    """A block's inverted lists with the contribution of each place."""

    def __init__(self, docs: int, term: np.ndarray, text: np.ndarray, values: np.ndarray, n_terms: int):
        self.docs, self.text, self.values = docs, text, values
        self.bounds = np.searchsorted(term, np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, best: Best, ids: np.ndarray, missing: np.ndarray) -> None:
        """Let the block's documents for one query into ``best``."""
        lows, highs = self.bounds[terms], self.bounds[terms + 1]
        sizes = highs - lows
        lists, short = [], []
        for low, high, size in zip(lows.tolist(), highs.tolist(), sizes.tolist()):
            if size * SHORT_SHARE > self.docs:
                lists.append((self.text[low:high], self.values[low:high]))
            elif size:
                short.append((low, high))
        if short:
            places = np.concatenate([np.arange(low, high) for low, high in short])
            sums = np.zeros(self.docs, np.int64)
            np.add.at(sums, self.text[places], self.values[places])
            held = np.flatnonzero(sums)
            lists.append((held, sums[held]))
        lists = [one for one in lists if len(one[0])]
        if lists:
            walk(lists, best, ids, missing)


def walk(lists: list[tuple[np.ndarray, np.ndarray]], best: Best, ids: np.ndarray, missing: np.ndarray) -> None:
    """Document by document over lists ordered by document, a stride at a time."""
    lists = sorted(lists, key=lambda one: int(one[1].max()))
    most = np.cumsum([int(values.max()) for _, values in lists])
    at, last = 0, int(max(docs[-1] for docs, _ in lists))
    while at <= last:
        floor = best.floor
        # The lists before ``leads`` cannot reach the floor together.
        leads = int(np.searchsorted(most, floor, side="left"))
        if leads == len(lists):
            return
        begins = [int(np.searchsorted(docs, at)) for docs, _ in lists[leads:]]
        stop = stride_end(lists[leads:], begins)
        if stop <= at:
            return
        parts = [slice(low, int(np.searchsorted(docs, stop))) for (docs, _), low in zip(lists[leads:], begins)]
        sums = np.zeros(stop - at, np.int64)
        for (docs, values), part in zip(lists[leads:], parts):
            sums[docs[part] - at] += values[part]
        found = np.flatnonzero(sums)
        scores, found = sums[found], found + at
        for rest in range(leads - 1, -1, -1):
            able = scores + most[rest] >= floor
            scores, found = scores[able], found[able]
            if not len(found):
                break
            docs, values = lists[rest]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            scores = scores + np.where(docs[place] == found, values[place], 0)
        able = scores >= floor
        if able.any():
            best.take(scores[able], ids[found[able]], missing[found[able]])
        at = stop


def stride_end(lists: list[tuple[np.ndarray, np.ndarray]], begins: list[int]) -> int:
    """Up to where the leading lists are walked next: the longest step that any of them makes in ``STRIDE`` places; 0 when all have ended."""
    return max(int(docs[min(low + STRIDE, len(docs) - 1)]) + 1 if low < len(docs) else 0 for (docs, _), low in zip(lists, begins))


def best_rows(docs: DataFrame, queries, counts: tuple[int, int, np.ndarray], k: int) -> DataFrame:
    """Each task's ``k`` best documents of every query of a pass: ``query``, ``doc_id``, ``score``, ``part``."""
    full, total, held = counts
    weight = np.array([math.floor(1000 * math.log((2 * full + 2) / (2 * int(n) + 1))) for n in held], np.int64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = [Best(k) for _ in asked.keys]
        for part in slices(batches, "text", BLOCK_BYTES):
            sizes, term, text, often = asked.counted(part.column("text"))
            lists = Lists(len(sizes), term, text, impacts(weight[term], often, length_parts(sizes, full, total)[text]), len(asked.names))
            missing = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(part.column("doc_id"), 0).to_numpy()
            for terms, mine in zip(asked.terms, best):
                lists.search(terms, mine, ids, missing)
        for key, mine in zip(asked.keys, best):
            if len(mine.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine.scores), key)), pa.array(mine.ids, mask=mine.missing), pa.array(mine.scores)], ["query", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(found, "query bigint, doc_id bigint, score bigint")


def ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``."""
    order = ", ".join(by)
    return rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {order} ORDER BY score DESC, doc_id ASC NULLS LAST)")).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` (above 0).

    A term is a run of ASCII letters and digits and of all that is not ASCII, A-Z in lower case. Every document counts for
    the statistics, whatever its length. Equal scores go by ascending ``doc_id``, a null one last. A null text has no terms; an
    item without terms, or whose terms no document holds, has no row; repeated rows of documents are ranked each; repeated items are answered once, and an id with
    several texts is answered for each of them; other columns are not read; empty tables give no row.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    asked = query_terms(items).filter(F.size("terms") > 0).dropDuplicates(["query"]).checkpoint()
    size = asked.agg(F.sum(F.length(F.array_join("terms", " ")))).first()[0] or 0
    passes = -(-size // QUERY_BYTES)
    found = None
    for block in range(passes):
        # A pass takes about ``QUERY_BYTES`` of queries along; hashes deal them evenly.
        rows = asked.filter(F.pmod("query", F.lit(passes)) == block).collect()
        queries = docs.sparkSession.sparkContext.broadcast(Queries(rows))
        mine = best_rows(docs, queries, statistics(docs, queries), k)
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query bigint, doc_id bigint, score bigint")
    # Tasks' results are cut once in salted groups, so no task gets those of all tasks.
    cut = ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))), ["query", "salt"], k).select("query", "doc_id", "score")
    return ranked(cut, ["query"], k).join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
