"""Scoring of texts by a language model: causal self-attention over subword ids, beside corpus counts of whole words.

Both are of all training texts. The attention model's tables are grouped sums; its weights start from windows out of every
block and are then trained on every window of the corpus, in rounds whose tasks train beside each other and are averaged. Each
word's probability is the mean of what both say, so the counts help with rare words and the attention with words the corpus
lacks and with what the text is about. Texts are split into blocks where they are read; each distinct word of a block
gets its corpus count by a join, and the block scores its texts in overlapping windows that score each id once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import attention
from .arrowio import slices, texts
from .attention import BATCH, CLASSES, SIDES, SIZE, STEPS, WINDOW, Adam, Model
from .bpe import Block, block_list, block_places, packed_numbers, words_of
from .subwords import word_vocabulary

BLOCK_BYTES = 16 * 1024 * 1024

ATTENTION = 0.5
"""Weight of the attention model in a word's probability."""

ROUNDS = 4
"""Rounds of training over the corpus; each takes its share of every task's blocks, and every block is in one."""

REFINE = 0.002
"""Rate of the first round; it falls from round to round."""

FAN_IN = 16
"""Tasks' changes that are summed in one task."""

SMOOTH = 0.1
CHUNK = 400_000
"""Words scored in one go."""

END, START = "<|endoftext|>", "<|startoftext|>"


def lowered(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts(column))


def held_out(doc_id: str = "doc_id") -> Column:
    """One text in ten, by the checksum of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(10)) == 0


def split_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lower-cased texts with their flags."""
    number, parts, many = TaskContext.get().partitionId() << 32, [], 0
    for part in slices(batches, "text", BLOCK_BYTES // 4):
        if many and many + part.nbytes > BLOCK_BYTES:
            yield text_block(number, parts)
            number, parts, many = number + 1, [], 0
        parts.append(part)
        many += part.nbytes
    if parts:
        yield text_block(number, parts)


def text_block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The row of a block: its distinct words by falling frequency, once, and the places of its texts' words among them."""
    table = pa.Table.from_batches(parts).combine_chunks()
    offsets, found = words_of(lowered(table.column("text").combine_chunks()))
    names, places = found.dictionary, found.indices.to_numpy()
    filled = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
    counts = np.where(filled, np.bincount(places, minlength=len(names)), -1)  # splitting leaves empty words at the ends of texts
    order = np.argsort(-counts, kind="stable")[: int(filled.sum())]
    rank = np.full(len(names) + 1, -1, np.int32)
    rank[order] = np.arange(len(order))
    places = rank[places]
    sizes = np.diff(np.concatenate([[0], np.cumsum(places >= 0)])[offsets - offsets[0]]).astype(np.int32)
    words = " ".join(names.take(pa.array(order)).to_pylist()).encode()
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
         pa.array([sizes], pa.list_(pa.int32())), pa.array([zstandard.compress(words)], pa.binary()),
         pa.array([packed_numbers(places[places >= 0])], pa.binary()), pa.array([table.column("held").to_pylist()], pa.list_(pa.bool_()))],
        ["block", "doc_ids", "sizes", "words", "places", "held"])


def with_ids(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Blocks with the subword ids of their words, so that no later pass encodes them again."""
    library = word_vocabulary(vocabulary)
    for batch in batches:
        for at in range(batch.num_rows):
            block = batch.slice(at, 1)
            ids, sizes = encoded(block_list(block.column("words")[0].as_py()), library)
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array([zstandard.compress(ids.tobytes())], pa.binary()), pa.array([packed_numbers(sizes)], pa.binary())],
                [*block.schema.names, "ids", "id_sizes"])


def word_array(packed: bytes) -> pa.Array:
    """A block's words as a column."""
    words = pa.array([zstandard.decompress(packed)], pa.binary()).cast(pa.string())
    return pc.split_pattern(words, " ").flatten() if len(words[0].as_py()) else words.slice(0, 0)


def encoded(words: list[str], library) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words, one word after the other, and how many each has."""
    packed = library.packed(words)
    return np.frombuffer(b"".join(packed), library.type), np.fromiter((len(p) for p in packed), np.int64, len(packed)) // library.type.itemsize


def block_ids(block: dict, library) -> tuple[np.ndarray, np.ndarray]:
    """What ``encoded`` gives for a block's words; encoded now if the block does not have it yet."""
    if "ids" not in block:
        return encoded(block_list(block["words"]), library)
    return np.frombuffer(zstandard.decompress(block["ids"]), library.type), block_places(block["id_sizes"]).astype(np.int64)


def training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words and how often its training texts have them."""
    for batch in batches:
        for block in batch.to_pylist():
            words, places = word_array(block["words"]), block_places(block["places"])
            counted = np.repeat(~np.array(block["held"], bool), block["sizes"])
            counts = np.bincount(places[counted], minlength=len(words))
            order = pc.array_sort_indices(words)  # sorted, they take less room in the shuffle
            for at in range(0, len(order), 50_000):
                some = order.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block["block"], np.int64)), words.take(some), pa.array(counts[some.to_numpy()], pa.int64())], ["block", "word", "n"])


def flat_ids(places: np.ndarray, words_of: np.ndarray, ids: np.ndarray, sizes: np.ndarray, ends: tuple[int, int]):
    """The ids of texts in one run, each text begun and ended by the special ids; where each begins, how many ids its words have, and each word's."""
    start, end = ends
    offsets = np.cumsum(sizes) - sizes
    per_word = sizes[places]
    before = np.concatenate([[0], np.cumsum(per_word)])
    edges = np.concatenate([[0], np.cumsum(words_of)])
    lengths = before[edges[1:]] - before[edges[:-1]]
    starts = np.cumsum(lengths + 2) - lengths - 2
    flat = np.empty(int((lengths + 2).sum()), np.int64)
    text = np.repeat(np.arange(len(words_of)), lengths)
    source = np.arange(before[-1]) - np.repeat(before[:-1], per_word) + np.repeat(offsets[places], per_word)
    flat[np.arange(before[-1]) + 2 * text + 1] = ids[source]
    flat[starts], flat[starts + lengths + 1] = start, end
    return flat, starts, lengths, per_word, before


def chunks(docs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last text, and first and last word, of pieces of a block of about ``CHUNK`` words."""
    bounds = np.concatenate([[0], np.cumsum(docs)])
    first = 0
    while first < len(docs):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, side="right")) - 1)
        yield first, last, int(bounds[first]), int(bounds[last])
        first = last


def special_ids(library) -> tuple[int, int]:
    return library.library.token_to_id(START), library.library.token_to_id(END)


def training_runs(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of all training texts of the blocks, in runs, with where the texts begin."""
    library = word_vocabulary(vocabulary)
    ends = special_ids(library)
    for batch in batches:
        for block in batch.to_pylist():
            ids, sizes = block_ids(block, library)
            docs, kept = np.array(block["sizes"], np.int64), ~np.array(block["held"], bool)
            places = block_places(block["places"]).astype(np.int64)[np.repeat(kept, docs)]
            docs = docs[kept]
            for first, last, low, high in chunks(docs):
                yield flat_ids(places[low:high], docs[first:last], ids, sizes, ends)[:2]


def tallied(runs: Iterator[tuple[np.ndarray, np.ndarray]], keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How often each key of the pairs of neighbouring ids of a text occurs in a task."""
    kept, counts, fresh, many = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = np.concatenate([kept, *(k for k, _ in fresh)]), np.concatenate([counts, *(n for _, n in fresh)])
        order = np.argsort(keys, kind="stable")
        keys, numbers = keys[order], numbers[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(numbers, first) if len(first) else numbers

    for flat, starts in runs:
        pair = np.ones(len(flat), bool)
        pair[starts] = False
        behind = np.flatnonzero(pair)
        fresh.append(np.unique(keys_of(flat[behind - 1], flat[behind]), return_counts=True))
        many += len(fresh[-1][0])
        if many > 1_000_000 + len(kept):
            kept, counts = merged()
            fresh, many = [], 0
    kept, counts = merged()
    for at in range(0, len(kept), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(kept[at:at + 50_000]), pa.array(counts[at:at + 50_000])], ["key", "n"])


def id_counts(words: DataFrame, vocabulary: str, ends: int) -> np.ndarray:
    """How often each id occurs in all training texts, from the counts of their words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = word_vocabulary(vocabulary)
        total = np.zeros(library.size, np.int64)
        for batch in batches:
            ids, sizes = encoded(batch.column("word").to_pylist(), library)
            np.add.at(total, ids, np.repeat(batch.column("c").to_numpy(), sizes))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["key", "n"])

    library = word_vocabulary(vocabulary)
    out = np.zeros(library.size, np.int64)
    found = words.select("word", "c").mapInArrow(made, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    out[list(special_ids(library))] += ends
    return out


def id_points(blocks: DataFrame, vocabulary: str, counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The point of each id with a count, from its neighbours in all training texts."""
    place = attention.neighbour_places(counts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tallied(training_runs(batches, vocabulary), lambda before, behind: attention.neighbour_keys(before, behind, place))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sides = part.column("sides")
                around = np.zeros((part.num_rows, SIDES), np.float32)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(sides).to_numpy())
                pairs = sides.flatten()
                around[row, pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
                found = attention.projected(around, by)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([p.tobytes() for p in found], pa.binary())], ["id", "point"])

    rows = blocks.mapInArrow(keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    each = rows.groupBy(F.floor(F.col("key") / SIDES).cast("bigint").alias("id")).agg(
        F.collect_list(F.struct((F.col("key") % SIDES).alias("side"), "n")).alias("sides"))
    found = each.mapInArrow(points, "id bigint, point binary").toArrow()
    out = np.zeros((len(counts), by.shape[1]), np.float32)
    if found.num_rows:
        out[found.column("id").to_numpy()] = np.frombuffer(b"".join(found.column("point").to_pylist()), np.float32).reshape(-1, by.shape[1])
    return out[np.flatnonzero(counts)]


def class_pairs(blocks: DataFrame, vocabulary: str, classes: np.ndarray) -> np.ndarray:
    """How often each id stands behind each class in all training texts."""
    size = len(classes)
    wide = classes.astype(np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tallied(training_runs(batches, vocabulary), lambda before, behind: wide[before] * size + behind)

    found = blocks.mapInArrow(keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * size, np.float32)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(CLASSES, size)


def opening_run(blocks: DataFrame, vocabulary: str, many: int) -> np.ndarray:
    """About ``STEPS * BATCH`` windows evenly out of every block, as one run of ids for the steps before the corpus is met; of more blocks than that, one window each out of as many."""
    each = -(-STEPS * BATCH // max(1, many))
    thin = max(1, many // (STEPS * BATCH))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                runs = [flat for flat, _ in training_runs(iter([batch.slice(at, 1)]), vocabulary)]
                run = np.concatenate(runs) if runs else np.zeros(0, np.int64)
                cuts = max(1, len(run) // WINDOW)
                if cuts > each:
                    run = run[(np.linspace(0, cuts - 1, each).astype(np.int64)[:, None] * WINDOW + np.arange(WINDOW)).ravel()]
                yield pa.RecordBatch.from_arrays([batch.slice(at, 1).column("block"), pa.array([run.astype(np.int32).tobytes()], pa.binary())], ["block", "run"])

    chosen = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(thin)) == 0)
    found = chosen.mapInArrow(made, "block bigint, run binary").collect()
    runs = [np.frombuffer(r.run, np.int32) for r in sorted(found, key=lambda r: r.block)]
    return np.concatenate([np.zeros(0, np.int32), *runs]).astype(np.int64)


def train_task(batches: Iterator[pa.RecordBatch], vocabulary: str, model: Model, rate: float, groups: int) -> Iterator[pa.RecordBatch]:
    """One pass of a task over all windows of its blocks: the changes of the weights, times how much the task saw.

    Windows follow each other, so each id behind another is predicted once; the last of a task is filled up with its own ids.
    """
    old = {k: v.copy() for k, v in model.weights.items()}
    mine = Model.__new__(Model)
    mine.__dict__.update(model.__dict__, weights={k: v.copy() for k, v in model.weights.items()})
    task = TaskContext.get().partitionId()
    adam, rng, places = Adam(mine), np.random.default_rng(task), np.arange(WINDOW + 1)
    met, seen, rest = np.zeros(len(model.classes), np.int64), 0, np.zeros(0, np.int64)

    def step(windows: np.ndarray) -> None:
        nonlocal seen
        adam.step(windows, rate)
        seen += len(windows)

    for flat, _ in training_runs(batches, vocabulary):
        run = np.concatenate([rest, flat])
        many = (len(run) - 1) // WINDOW
        order = rng.permutation(many) * WINDOW
        for at in range(0, many, BATCH):
            step(run[order[at:at + BATCH, None] + places])
        met += np.bincount(run[:many * WINDOW], minlength=len(met))
        rest = run[many * WINDOW:]
    if len(rest) > 1:
        last = np.resize(rest, WINDOW + 1)
        step(last[None])
        met += np.bincount(last[:-1], minlength=len(met))
    if seen:
        change = {k: (mine.weights[k] - old[k]) * (met[:, None] if k == "ids" else seen) for k in old}
        yield pa.RecordBatch.from_arrays(
            [pa.array([task % groups], pa.int64()), pa.array([seen], pa.int64()), pa.array([met.tobytes()], pa.binary()),
             pa.array([np.concatenate([change[k].ravel() for k in sorted(change)]).astype(np.float32).tobytes()], pa.binary())], ["part", "seen", "met", "change"])


def summed_changes(part: int, rows: pa.Table) -> pa.Table:
    seen, met, change = 0, 0, 0
    for row in rows.to_batches(max_chunksize=1):
        seen += row.column("seen")[0].as_py()
        met = met + np.frombuffer(row.column("met")[0].as_buffer(), np.int64)
        change = change + np.frombuffer(row.column("change")[0].as_buffer(), np.float32).astype(np.float64)
    return pa.table({"part": [part], "seen": [seen], "met": pa.array([met.tobytes()], pa.binary()),
                     "change": pa.array([change.astype(np.float32).tobytes()], pa.binary())})


def train_round(blocks: DataFrame, vocabulary: str, model: Model, rate: float) -> None:
    """Every task trains on all its windows from the same weights; they move by the mean change, an id's by that of the tasks that met it.

    Changes are summed in a tree: no task, nor the driver, takes more than ``FAN_IN`` of them.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the vocabulary
    kind = "part bigint, seen bigint, met binary, change binary"
    groups = max(1, -(-blocks.rdd.getNumPartitions() // FAN_IN))
    width = groups
    rows = blocks.mapInArrow(lambda batches: train_task(batches, vocabulary, shared.value, rate, width), kind)
    while True:
        rows = rows.groupBy("part").applyInArrow(lambda key, table: summed_changes(key[0].as_py(), table), kind)
        if groups <= FAN_IN:
            break
        groups = -(-groups // FAN_IN)
        rows = rows.withColumn("part", F.col("part") % groups)
    found = rows.toArrow()
    if not found.num_rows:
        return
    total = summed_changes(0, found).to_pylist()[0]
    change, at = np.frombuffer(total["change"], np.float32), 0
    for name in sorted(model.weights):
        weight = model.weights[name]
        share = np.maximum(1, np.frombuffer(total["met"], np.int64))[:, None] if name == "ids" else total["seen"]
        model.weights[name] = (weight + change[at:at + weight.size].reshape(weight.shape) / share).astype(np.float32)
        at += weight.size


def trained_model(blocks: DataFrame, words: DataFrame, vocabulary: str, ends: int, seed: int = 7) -> Model:
    """The attention model of all training texts: tables by grouped sums, weights by one pass over every window."""
    rng = np.random.default_rng(seed)
    number = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    many, most = blocks.agg(F.count(F.lit(1)), F.max(number)).first()
    counts = id_counts(words, vocabulary, ends)
    classes = attention.grouped_classes(counts, id_points(blocks, vocabulary, counts, attention.projection(rng))) if counts.any() else np.zeros(len(counts), np.int16)
    model = attention.from_counts(counts, classes, class_pairs(blocks, vocabulary, classes), rng)
    model.train(opening_run(blocks, vocabulary, many), STEPS, rng)
    rounds = min(ROUNDS, most + 1) if many else 0
    for turn in range(rounds):
        train_round(blocks.filter(number % rounds == turn), vocabulary, model, REFINE * (1 - turn / rounds))
    return model


def score_block(blocks: pa.Table, table: pa.Table, model: Model, vocabulary: str, total: int, kinds: int, ends: int) -> pa.Table:
    """Scores of the texts of a block, whose words come with their corpus counts."""
    library = word_vocabulary(vocabulary)
    special = special_ids(library)
    log_base = lambda counts: np.log10((counts + SMOOTH) / (total + SMOOTH * (kinds + 1)))
    out: list[list] = [[], [], [], [], [], []]
    for block in blocks.to_pylist():
        words = word_array(block["words"])
        counts = np.zeros(len(words), np.int64)
        if table.num_rows:
            at = pc.index_in(words, value_set=table.column("word").combine_chunks())
            counts = pc.fill_null(table.column("c").combine_chunks().take(at), 0).to_numpy().astype(np.int64)
        base = log_base(counts)
        ids, sizes = block_ids(block, library)
        places, docs = block_places(block["places"]).astype(np.int64), np.array(block["sizes"], np.int64)
        end_base = float(log_base(np.array(ends)))
        for first, last, low, high in chunks(docs):
            mine, words_of = places[low:high], docs[first:last]
            flat, starts, lengths, per_word, before = flat_ids(mine, words_of, ids, sizes, special)
            scores = model.score(flat, starts, lengths + 1) / np.log(10)
            ending = starts - np.arange(len(starts)) + lengths
            inner = np.delete(scores, ending)
            sums = np.concatenate([[0], np.cumsum(inner, dtype=np.float64)])
            attention = np.where(per_word > 0, sums[before[1:]] - sums[before[:-1]], -np.inf)
            attention, end_score = np.concatenate([attention, scores[ending]]), np.full(len(starts), end_base)
            both = np.concatenate([base[mine], end_score])
            mixed = np.logaddexp(np.log(ATTENTION) + attention * np.log(10), np.log(1 - ATTENTION) + both * np.log(10)) / np.log(10)
            owner = np.concatenate([np.repeat(np.arange(len(words_of)), words_of), np.arange(len(words_of))])
            known = np.concatenate([counts[mine] > 0, np.full(len(starts), ends > 0)])
            out[0] += block["doc_ids"][first:last]
            out[1] += block["held"][first:last]
            for column, values in zip(out[2:], (words_of + 1, np.bincount(owner, known, len(words_of)).astype(np.int64),
                                                np.bincount(owner, both, len(words_of)), np.bincount(owner, mixed, len(words_of)))):
                column += values.tolist()
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    Tokens are the words after lower-casing A-Z, and one end. ``base_score`` is that of the smoothed word counts alone. A null
    text is empty and has the end alone; a null ``doc_id`` stays null and is held out; repeated rows are scored, and counted,
    each; a word without subword ids is scored by the counts alone; without training texts the model is untrained and all
    counts are nought; other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("held", held_out())
    ends = docs.filter(~F.col("held")).count()
    kind = f"{Block.KIND}, held array<boolean>"
    blocks = docs.mapInArrow(lambda batches: with_ids(split_texts(batches), vocabulary), f"{kind}, ids binary, id_sizes binary").checkpoint()
    used = blocks.select("block", "sizes", "words", "places", "held").mapInArrow(training_counts, "block bigint, word string, n bigint")
    counts = used.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")).checkpoint()
    row = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total, kinds = (row[0] or 0) + ends, row[1] + (ends > 0)
    model = spark.sparkContext.broadcast(trained_model(blocks, counts.filter("c > 0"), vocabulary, ends))  # bounded by the vocabulary
    known = used.join(counts.filter("c > 0"), "word").select("block", "word", "c")
    scored = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        lambda left, right: score_block(left, right, model.value, vocabulary, total, kinds, ends),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
